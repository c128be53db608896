"""Form extraction, mapping, classification and evaluation.

The given pages hold no forms, so each customer gets an application page
built from its own row, one of five layouts by market segment, and is its own
candidate.  Work therefore grows with the customer table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave import schemas
from formweave.functions.urls import parse_job_title
from formweave.operators import evaluate as E
from formweave.operators import extract as X
from formweave.operators import fill as L
from formweave.operators.classify import classify_forms
from formweave.operators.mapping import map_fields
from formweave.operators.profiles import profile_values
from formweave.plans.common import table
from formweave.session import checkpoint_dir
from formweave.sources import files

QUESTION = "What makes this team interesting to you?"
NEAR_QUESTION = "What really makes this team interesting to you?"
COUNTRIES = ["USA", "Deutschland", "UK", "South Africa", "Narnia"]
LAYOUTS = {
    "AUTOMOBILE": ("https://boards.greenhouse.io/x/jobs/{k}", """<html><head><title>Opening {k}</title></head><body>
<form id="f"><label for="first_name">Given <b>name</b> *</label><input id="first_name" required>
<label for="email">Mail</label><input id="email" type="email"><label for="resume">CV</label>
<input type="file" id="resume" accept=".pdf"><h3>Legal</h3><label for="q1">Are you legally authorized to work here? *</label>
<select id="q1"><option value="">Choose<option value="1">Yes<option value="0">No</select>
<h3>About you</h3><label for="job_application_gender">Gender</label><select id="job_application_gender">
<option value="1">Male</option><option value="3">Decline To Self Identify</option></select></form></body></html>"""),
    "BUILDING": ("https://jobs.lever.co/x/{k}", """<html><head><title>Acme {k} - Nurse</title></head><body><form>
<div><div class="t">Full name ✱</div><div><input name="name"></div></div><div><div class="t">Employer</div><div><input name="org">
</div></div><div><div class="t">""" + QUESTION + """</div><div><textarea name="cards[x][f]"></textarea></div></div></form></body></html>"""),
    "FURNITURE": ("https://jobs.ashbyhq.com/x/{k}", """<div><form><div><label for="_systemfield_name">Name *</label>
<input id="_systemfield_name"></div><div><label for="z">Do you require visa sponsorship to work here?</label>
<input id="z" role="combobox" aria-controls="zl"><div id="zl" role="listbox"><div role="option" data-value="y">Yes</div>
<div role="option" data-value="n">No</div></div></div></form></div>"""),
    "HOUSEHOLD": ("https://www.contoso.example/careers/{k}", """<html><head><title>Contoso</title></head><body><h1>Apply</h1><form name="a">
<input autocomplete="section-x given-name" aria-label="Vorname"><label for="co">Country</label><select id="co">
<option value="ZA">South Africa (ZA)</option><option value="DE">Germany</option><option value="x">United States of America</option>
<option value="GB">United Kingdom (UK)</option></select><fieldset><legend>Which of the following skills do you use?</legend>
<label><input type="checkbox" name="sk" value="ts"> TypeScript</label><label><input type="checkbox" name="sk" value="go"> Go</label>
<label><input type="checkbox" name="sk" checked> Rust</label></fieldset><label for="min">Minimum salary (EUR)</label>
<input id="min" type="number" value="{k}"><label><input type="checkbox" id="ok"> I certify that this is true</label></form></body></html>"""),
    "MACHINERY": ("https://app.example/login", """<html><head><title>Sign in {k}</title></head><body><form>
<label for="e">Email</label><input id="e" type="email"><label for="p">Password</label><input id="p" type="password"></form></body></html>"""),
}
GOLDEN = {
    "AUTOMOBILE": ({"#first_name": "basics.firstName", "#email": "basics.email", "#resume": "attachments.resume",
                    "#q1": "preferences.workAuth", "#job_application_gender": "eeo.gender"}, []),
    "BUILDING": ({'input[name="name"]': "basics.fullName", 'input[name="org"]': "work.company"}, []),
    "FURNITURE": ({"#_systemfield_name": "basics.fullName", "#z": "preferences.requiresSponsorship", "#none": "basics.phone"}, []),
    "HOUSEHOLD": ({"#co": "location.country", 'input[name="sk"]': "skills.list", "#min": "preferences.salary"}, ["#ok"]),
    "MACHINERY": ({"#p": "custom.password"}, ["#e"]),
}
# other spellings of selectors: segment, selector, wanted key (None: must not be filled), the field it names
SPELLED = [
    ("AUTOMOBILE", "input#first_name", "work.title", 0), ("AUTOMOBILE", "input[type = 'file']", "attachments.coverLetter", 2),
    ("AUTOMOBILE", "[id=email][type=email]", "basics.email", 1), ("AUTOMOBILE", "select#q2", "eeo.race", None), ("AUTOMOBILE", "select", None, 3),
    ("BUILDING", "[name=org]", "work.company", 1), ("BUILDING", "textarea[name^='cards[']", "custom.other", 2),
    ("BUILDING", "input[name=name][required]", None, None), ("FURNITURE", "div[role=listbox]", "preferences.requiresSponsorship", 2),
    ("FURNITURE", "INPUT[role|=combobox]", "eeo.race", 1), ("FURNITURE", "input:not([id])", None, None),
    ("HOUSEHOLD", "[name='sk'][checked]", "skills.list", 2), ("HOUSEHOLD", "input[value=go]", "location.city", 2),
    ("HOUSEHOLD", "[autocomplete~=given-name]", "basics.lastName", 0), ("HOUSEHOLD", "[type$=ber]", None, 3),
    ("MACHINERY", "input[type=password].x", "custom.password", None), ("MACHINERY", "input", None, 0),
]


def _by_segment(values: dict[str, Column]) -> Column:
    chain = F
    for segment, value in values.items():
        chain = chain.when(F.col("c_mktsegment") == segment, value)
    return chain


def _fill(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col("c_custkey").cast("string"))


def form_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("page_id"),
        _by_segment({s: _fill(u) for s, (u, _) in LAYOUTS.items()}).alias("url"),
        _by_segment({s: _fill(h) for s, (_, h) in LAYOUTS.items()}).alias("html"),
    )


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return X.form_signals(X.page_nodes(form_pages(spark, d)))


def page_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which a floating button would be shown: two fields at least; a customer's page, or a single-field one."""
    pages = form_pages(spark, d)
    single = pages.withColumns({
        "page_id": F.concat("page_id", F.lit("-single")),
        "html": F.concat(F.lit("<label>Mail <input type=email name=m"), "page_id", F.lit("></label>")),
    })
    return X.with_form_controls(pages.unionByName(single)).select("page_id")


def _stored_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals written once: they are read beside their decisions, and pages are dear to parse."""
    checkpoint_dir(spark)
    return _signals(spark, d).checkpoint()


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    given = F.col("c_acctbal") > 5000
    set_to = lambda v: F.when(given, v)
    explicit = {
        "workAuth": F.lit("Yes"), "requiresSponsorship": F.lit("No"), "gender": F.lit("Prefer not to say"),
        "salaryMin": F.concat(F.lit("$"), F.floor("c_acctbal")),
    }
    null = F.lit(None).cast("string")
    names = [m.split(":")[0] for m in schemas.EXPLICIT[7:-1].split(",")]
    country = F.get(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("c_nationkey") % 5)
    empty = F.lit("")
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("cand"), F.lit(1).alias("version"),
        F.struct(
            F.lit("Customer").alias("firstName"), F.substring("c_name", 10, 20).alias("lastName"),
            F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@mail.example")).alias("email"),
            F.concat(F.lit("+44 20 "), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"), empty.alias("pronouns"),
        ).alias("basics"),
        F.struct(empty.alias("street"), F.lit("Town").alias("city"), empty.alias("region"), country.alias("country"),
                 empty.alias("postalCode")).alias("location"),
        F.struct(*[empty.alias(n) for n in ("linkedin", "github", "portfolio", "website")]).alias("links"),
        F.array().cast(f"array<{schemas.WORK}>").alias("work"), F.array().cast(f"array<{schemas.EDUCATION}>").alias("education"),
        F.array(F.lit("TypeScript"), F.lit("Rust")).alias("skills"),
        F.struct(*[(set_to(explicit[n]) if n in explicit else null).alias(n) for n in names]).alias("explicit"),
    )


def _answers(spark: SparkSession, d: str) -> DataFrame:
    near = F.col("c_nationkey") % 4 == 2
    key = lambda q: q.lower().rstrip("?")
    return table(spark, d, "customer").filter(F.col("c_nationkey") % 2 == 0).select(
        F.col("c_custkey").cast("string").alias("cand"), F.lit("a").alias("id"),
        F.when(near, NEAR_QUESTION).otherwise(QUESTION).alias("question_text"),
        F.when(near, key(NEAR_QUESTION)).otherwise(key(QUESTION)).alias("normalized_key"),
        F.array().cast("array<string>").alias("alias_keys"), F.lit("I like {company}").alias("answer"),
        F.lit(0).cast("long").alias("times_used"), F.lit(0).cast("long").alias("last_used_us"), F.lit(0).cast("long").alias("created_us"),
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_nationkey") % 3 != 0).select(
        F.col("c_custkey").cast("string").alias("cand"), F.concat(F.lit("d"), F.col("c_custkey")).alias("id"), F.lit("resume").alias("role"),
        F.concat(F.lit("cv"), F.col("c_custkey"), F.lit(".pdf")).alias("file_name"), F.lit("application/pdf").alias("mime"),
        F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("added_us"),
    )


def _decisions(spark: SparkSession, d: str, signals: DataFrame) -> DataFrame:
    asked = (
        signals.withColumn("cand", F.col("page_id")).withColumn("date_format_hint", F.lit("MM/DD/YYYY"))
        .withColumn("_c", parse_job_title(F.coalesce(F.col("title"), F.lit("")), F.col("ats")))
        .withColumn("company", F.col("_c.company")).withColumn("role", F.col("_c.role")).drop("_c")
    )
    return map_fields(asked, _profiles(spark, d), _answers(spark, d), _documents(spark, d))


def form_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "page_id", "ref", "kind", "label", "label_source", "required", "section_heading", "ats", "widget_hint",
        F.coalesce(F.size("options"), F.lit(0)).cast("long").alias("options"), "current_value",
    )


def form_detection(spark: SparkSession, d: str) -> DataFrame:
    signals = _signals(spark, d)
    titles = form_pages(spark, d).select(
        "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")
    )
    return classify_forms(titles, signals).select(
        "page_id", F.col("score").cast("long").alias("score"), "is_application", F.array_join("reasons", "; ").alias("reasons")
    )


def field_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d, _signals(spark, d)).select(
        "page_id", "ref", "canonical", "source", "value", "action", "confidence"
    )


def field_actions(spark: SparkSession, d: str) -> DataFrame:
    return L.action_counts(_decisions(spark, d, _signals(spark, d))).drop("cand")


def fill_instructions(spark: SparkSession, d: str) -> DataFrame:
    signals = _stored_signals(spark, d)
    out = L.instructions(_decisions(spark, d, signals), signals, _documents(spark, d))
    return out.select("page_id", "ref", F.col("payload.type").alias("type"), "amber")


def _judged(spark: SparkSession, d: str, wanted: dict[str, tuple[dict[str, str], list[str]]]) -> DataFrame:
    """Golden labels of every page against the decisions."""
    label = lambda s, c: F.struct(F.lit(s).alias("selector"), F.lit(c).alias("canonical"))
    golden = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("page_id"),
        _by_segment({s: _fill(u) for s, (u, _) in LAYOUTS.items()}).alias("url"),
        _by_segment({s: F.array(*[label(k, c) for k, c in fields.items()]) for s, (fields, _) in wanted.items()}).alias("fields"),
        _by_segment({s: F.array(*[F.lit(x) for x in no]).cast("array<string>") for s, (_, no) in wanted.items()}).alias("expect_no_fill"),
    )
    signals = _stored_signals(spark, d)
    return E.judge(golden, signals, _decisions(spark, d, signals))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return E.scores(_judged(spark, d, GOLDEN)).withColumns({
        "recall": F.round("recall", 6), "precision": F.round("precision", 6),
    })


def eval_mistakes(spark: SparkSession, d: str) -> DataFrame:
    """Labels in other spellings that were missed, filled wrongly or filled at all."""
    wanted = {
        s: ({x: key for seg, x, key, _ in SPELLED if seg == s and key}, [x for seg, x, key, _ in SPELLED if seg == s and not key])
        for s in LAYOUTS
    }
    return E.mistakes(_judged(spark, d, wanted))


_SCORES = ["labels", "detected", "filled", "correct", "forbidden", "recall", "precision"]


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores per board and overall."""
    return _scored(spark, d).filter("page_id IS NULL").select(F.coalesce(F.col("ats"), F.lit("all")).alias("ats"), *_SCORES)


def eval_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every page."""
    return _scored(spark, d).filter("page_id IS NOT NULL").select("page_id", "ats", *_SCORES)


def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    return profile_values(_profiles(spark, d)).select("cand", "key", "text", "explicit")


def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All candidates exported and imported again."""
    settings = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("cand"), F.lit("MM/DD/YYYY").alias("date_format_hint")
    )
    bundle = files.export_bundle(_profiles(spark, d), _answers(spark, d), _documents(spark, d), settings, 0)
    profiles, answers, documents, _ = files.import_bundle(bundle)
    part = lambda df, section, value: df.select("cand", F.lit(section).alias("section"), value.alias("value"))
    return (
        part(profiles, "profile", F.concat_ws(" ", "basics.email", "explicit.salaryMin"))
        .unionByName(part(answers, "answer", F.col("question_text")))
        .unionByName(part(documents, "document", F.col("file_name")))
    )


QUERIES = {
    f.__name__: f
    for f in (form_signals, page_gate, form_detection, field_mapping, field_actions, fill_instructions, eval_scores, eval_pages, eval_mistakes, profile_lookup,
              bundle_round_trip)
}

_C = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS seg, c_nationkey AS n, c_acctbal > 5000 AS given,
    CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS bal, substr(c_name, 10) AS num,
    ['USA', 'Deutschland', 'UK', 'South Africa', 'Narnia'][c_nationkey % 5 + 1] AS country FROM customer)"""

# expected decisions: segment, ref, canonical, source, value, action, confidence
_EXPECTED = [
    ("AUTOMOBILE", 0, "'basics.firstName'", "'adapter'", "'Customer'", "'fill'", "1.0"),
    ("AUTOMOBILE", 1, "'basics.email'", "'adapter'", "'c' || k || '@mail.example'", "'fill'", "1.0"),
    ("AUTOMOBILE", 2, "'attachments.resume'", "CASE WHEN n % 3 <> 0 THEN 'adapter' END", "CASE WHEN n % 3 <> 0 THEN 'cv' || k || '.pdf' END",
     "CASE WHEN n % 3 <> 0 THEN 'fill-amber' ELSE 'abstain' END", "CASE WHEN n % 3 <> 0 THEN 1.0 ELSE 0.0 END"),
    ("AUTOMOBILE", 3, "'preferences.workAuth'", "'lexicon'", "CASE WHEN given THEN 'Yes' END",
     "CASE WHEN given THEN 'fill-amber' ELSE 'review' END", "CASE WHEN given THEN 0.91 ELSE 0.0 END"),
    ("AUTOMOBILE", 4, "'eeo.gender'", "'adapter'", "CASE WHEN given THEN 'Prefer not to say' END",
     "CASE WHEN given THEN 'fill-amber' ELSE 'review' END", "CASE WHEN given THEN 1.0 ELSE 0.0 END"),
    ("BUILDING", 0, "'basics.fullName'", "'adapter'", "'Customer ' || num", "'fill'", "1.0"),
    ("BUILDING", 1, "'work.company'", "NULL", "NULL", "'abstain'", "0.0"),
    ("BUILDING", 2, "CASE n % 4 WHEN 0 THEN 'custom.what makes this team interesting to you' "
     "WHEN 2 THEN 'custom.what really makes this team interesting to you' END",
     "CASE n % 4 WHEN 0 THEN 'answer-exact' WHEN 2 THEN 'answer-fuzzy' END", "CASE WHEN n % 2 = 0 THEN 'I like Acme ' || k END",
     "CASE n % 4 WHEN 0 THEN 'fill' WHEN 2 THEN 'fill-amber' ELSE 'abstain' END", "CASE n % 4 WHEN 0 THEN 0.955 WHEN 2 THEN 0.811 ELSE 0.0 END"),
    ("FURNITURE", 0, "'basics.fullName'", "'adapter'", "'Customer ' || num", "'fill'", "1.0"),
    *[("FURNITURE", i, "'preferences.requiresSponsorship'", "'lexicon'", "CASE WHEN given THEN 'No' END",
       "CASE WHEN given THEN 'fill-amber' ELSE 'review' END", "CASE WHEN given THEN 0.91 ELSE 0.0 END") for i in (1, 2)],
    ("HOUSEHOLD", 0, "'basics.firstName'", "'autocomplete'", "'Customer'", "'fill'", "0.978"),
    ("HOUSEHOLD", 1, "'location.country'", "'lexicon'", "country", "CASE WHEN country = 'Narnia' THEN 'review' ELSE 'fill' END",
     "CASE WHEN country = 'Narnia' THEN 0.0 ELSE 0.91 END"),
    ("HOUSEHOLD", 2, "'skills.list'", "'lexicon'", "'TypeScript, Rust'", "'fill'", "0.91"),
    ("HOUSEHOLD", 3, "'preferences.salaryMin'", "'lexicon'", "CASE WHEN given THEN bal END",
     "CASE WHEN given THEN 'fill-amber' ELSE 'review' END", "CASE WHEN given THEN 0.91 ELSE 0.0 END"),
    ("HOUSEHOLD", 4, "NULL", "NULL", "NULL", "'review'", "0.0"),
    ("MACHINERY", 0, "'basics.email'", "'lexicon'", "'c' || k || '@mail.example'", "'fill'", "0.91"),
    ("MACHINERY", 1, "NULL", "NULL", "NULL", "'abstain'", "0.0"),
]
_X = "x AS (" + "\nUNION ALL ".join(
    f"SELECT k AS page_id, seg, 'top:f{i}' AS ref, CAST({canonical} AS VARCHAR) AS canonical, CAST({source} AS VARCHAR) AS source, "
    f"CAST({value} AS VARCHAR) AS value, {action} AS action, CAST({confidence} AS DOUBLE) AS confidence FROM c WHERE seg = '{seg}'"
    for seg, i, canonical, source, value, action, confidence in _EXPECTED
) + ")"

# expected signals: segment, ref, kind, label, source, required, heading, options, current value
_SIGNALS = [
    ("AUTOMOBILE", 0, "text", "Given name", "label-for", True, None, 0, None),
    ("AUTOMOBILE", 1, "email", "Mail", "label-for", False, None, 0, None),
    ("AUTOMOBILE", 2, "file", "CV", "label-for", False, None, 0, None),
    ("AUTOMOBILE", 3, "select", "Are you legally authorized to work here?", "label-for", True, "Legal", 3, None),
    ("AUTOMOBILE", 4, "select", "Gender", "label-for", False, "About you", 2, "'1'"),
    ("BUILDING", 0, "text", "Full name", "geometric", False, None, 0, None),
    ("BUILDING", 1, "text", "Employer", "geometric", False, None, 0, None),
    ("BUILDING", 2, "textarea", QUESTION, "geometric", False, None, 0, None),
    ("FURNITURE", 0, "text", "Name", "label-for", True, None, 0, None),
    ("FURNITURE", 1, "aria_combobox", "Do you require visa sponsorship to work here?", "label-for", False, None, 2, None),
    ("FURNITURE", 2, "aria_listbox", "Do you require visa sponsorship to work here?", "geometric", False, None, 2, "'Yes\nNo'"),
    ("HOUSEHOLD", 0, "text", "Vorname", "aria-label", False, "Apply", 0, None),
    ("HOUSEHOLD", 1, "select", "Country", "label-for", False, "Apply", 4, "'ZA'"),
    ("HOUSEHOLD", 2, "multiselect", "Which of the following skills do you use?", "label-for", False,
     "Which of the following skills do you use?", 3, "'on'"),
    ("HOUSEHOLD", 3, "number", "Minimum salary (EUR)", "label-for", False, "Which of the following skills do you use?", 0, "k"),
    ("HOUSEHOLD", 4, "checkbox", "I certify that this is true", "label-for", False, "Which of the following skills do you use?", 0, "'false'"),
    ("MACHINERY", 0, "email", "Email", "label-for", False, None, 0, None),
    ("MACHINERY", 1, "text", "Password", "label-for", False, None, 0, None),
]
_BOARDS = {"AUTOMOBILE": "greenhouse", "BUILDING": "lever", "FURNITURE": "ashby", "HOUSEHOLD": "generic", "MACHINERY": "generic"}


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


_BOARD_SQL = "CASE seg WHEN 'AUTOMOBILE' THEN 'greenhouse' WHEN 'BUILDING' THEN 'lever' WHEN 'FURNITURE' THEN 'ashby' ELSE 'generic' END"

def _eval_sql(by: str, group: str) -> str:
    return f"""WITH {_C}, {_X},
g AS (SELECT page_id, {_BOARD_SQL} AS ats, ref, seg, action IN ('fill', 'fill-amber') AS f,
        NOT (seg = 'MACHINERY' AND ref = 'top:f0') AND NOT (seg = 'HOUSEHOLD' AND ref = 'top:f4') AS is_label,
        NOT (seg = 'HOUSEHOLD' AND ref = 'top:f3') AS right_key
      FROM x WHERE NOT (seg = 'BUILDING' AND ref = 'top:f2') AND NOT (seg = 'FURNITURE' AND ref = 'top:f2')
        AND NOT (seg = 'HOUSEHOLD' AND ref = 'top:f0')
      UNION ALL SELECT k, 'ashby', NULL, seg, false, true, false FROM c WHERE seg = 'FURNITURE'),
r AS (SELECT {by}, count(*) FILTER (is_label) AS labels, count(*) FILTER (is_label AND ref IS NOT NULL) AS detected,
        count(*) FILTER (f) AS filled, count(*) FILTER (is_label AND f AND right_key) AS correct,
        count(*) FILTER (NOT is_label AND f) AS forbidden FROM g GROUP BY {group})
SELECT *, CASE WHEN labels > 0 THEN round(detected / labels, 6) END AS recall,
  CASE WHEN filled > 0 THEN round(correct / filled, 6) END AS precision FROM r"""


def _mistakes_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    spelled = ", ".join(
        f"({quoted(s)}, {quoted(x)}, {quoted(key)}, {quoted(None if f is None else f'top:f{f}')})" for s, x, key, f in SPELLED
    )
    return f"""WITH {_C}, {_X}, s(seg, selector, wanted, ref) AS (VALUES {spelled})
SELECT k AS page_id, selector, 'MISSED ' || selector || ' (' || wanted || ')' AS mistake
FROM c JOIN s USING (seg) WHERE ref IS NULL AND wanted IS NOT NULL
UNION ALL SELECT page_id, selector, CASE WHEN wanted IS NULL THEN 'FORBIDDEN FILL ' || selector || ': ' || canonical || ' = "' || value || '"'
    ELSE 'WRONG ' || selector || ': mapped to ' || canonical || ' (wanted ' || wanted || '), value="' || value || '"' END
FROM x JOIN s USING (seg, ref) WHERE action IN ('fill', 'fill-amber') AND (wanted IS NULL OR wanted <> canonical)"""


ORACLES = {
    "page_gate": "SELECT CAST(c_custkey AS VARCHAR) AS page_id FROM customer",
    "form_signals": f"WITH {_C} " + "\nUNION ALL ".join(
        f"SELECT k AS page_id, 'top:f{i}' AS ref, '{kind}' AS kind, '{label}' AS label, '{src}' AS label_source, {req} AS required, "
        f"{_text(head)} AS section_heading, '{_BOARDS[seg]}' AS ats, "
        f"'{'ashby_combobox' if kind.startswith('aria') else 'native'}' AS widget_hint, CAST({opts} AS BIGINT) AS options, "
        f"CAST({cur or 'NULL'} AS VARCHAR) AS current_value FROM c WHERE seg = '{seg}'"
        for seg, i, kind, label, src, req, head, opts, cur in _SIGNALS
    ),
    "form_detection": f"""WITH {_C}
SELECT k AS page_id, CAST(CASE seg WHEN 'AUTOMOBILE' THEN 10 WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN -3 ELSE 6 END AS BIGINT) AS score,
  seg IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD') AS is_application,
  CASE seg WHEN 'AUTOMOBILE' THEN '+3 resume/CV upload field; +2 4 recognized application fields; +2 work-authorization/EEO questions present; +1 email field; +2 application-like URL'
    WHEN 'BUILDING' THEN '+1 2 recognized application fields; +2 application-like URL'
    WHEN 'MACHINERY' THEN '+1 email field; -4 password/payment fields present'
    ELSE '+2 3 recognized application fields; +2 work-authorization/EEO questions present; +2 application-like URL' END AS reasons FROM c""",
    "field_mapping": f"WITH {_C}, {_X} SELECT page_id, ref, canonical, source, value, action, confidence FROM x",
    "field_actions": f"""WITH {_C}, {_X}
SELECT page_id, count(*) FILTER (action IN ('fill', 'fill-amber')) AS ready, count(*) FILTER (action = 'review') AS review,
       count(*) FILTER (action = 'abstain') AS abstained FROM x GROUP BY page_id""",
    "fill_instructions": f"""WITH {_C}, {_X}
SELECT page_id, ref, CASE WHEN canonical = 'attachments.resume' THEN 'file' WHEN canonical = 'skills.list' THEN 'multi'
  WHEN action <> 'review' AND (canonical IN ('eeo.gender', 'preferences.workAuth', 'preferences.requiresSponsorship', 'location.country'))
  THEN 'option' ELSE 'text' END AS type, action <> 'fill' AS amber FROM x WHERE value IS NOT NULL""",
    "eval_scores": _eval_sql("coalesce(ats, 'all') AS ats", "ROLLUP (ats)"),
    "eval_pages": _eval_sql("page_id, ats", "page_id, ats"),
    "eval_mistakes": _mistakes_sql(),
    "profile_lookup": f"""WITH {_C}
SELECT k AS cand, key, text, explicit FROM (
  SELECT k, unnest(['basics.firstName', 'basics.lastName', 'basics.fullName', 'basics.email', 'basics.phone', 'basics.phoneCountryCode',
                    'location.city', 'location.country', 'location.full', 'skills.list']) AS key,
         unnest(['Customer', num, 'Customer ' || num, 'c' || k || '@mail.example', '+44 20 ' || lpad(k, 8, '0'), '+44', 'Town', country,
                 'Town, ' || country, 'TypeScript, Rust']) AS text, false AS explicit FROM c
  UNION ALL
  SELECT k, unnest(['preferences.workAuth', 'preferences.requiresSponsorship', 'preferences.salaryMin', 'eeo.gender']),
         unnest(['Yes', 'No', '$' || bal, 'Prefer not to say']), true FROM c WHERE given)""",
    "bundle_round_trip": f"""WITH {_C}
SELECT k AS cand, 'profile' AS section, 'c' || k || '@mail.example' || CASE WHEN given THEN ' $' || bal ELSE '' END AS value FROM c
UNION ALL SELECT k, 'answer', CASE n % 4 WHEN 2 THEN '{NEAR_QUESTION}' ELSE '{QUESTION}' END FROM c WHERE n % 2 = 0
UNION ALL SELECT k, 'document', 'cv' || k || '.pdf' FROM c WHERE n % 3 <> 0""",
}
