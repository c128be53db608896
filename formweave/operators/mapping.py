"""From field signals to decisions, for many candidates and pages at once.

signals: cand, page_id, ref, kind, label, placeholder, name_attr, id_attr,
autocomplete, section_heading, options, visible, accept, max_length, ats,
company, role, date_format_hint.

Keys come from literal rule tables without a join.  Profile values and
documents, one row a candidate, join on the candidate; only what the rules
leave open goes to the saved answers, as distinct questions.  Rows without a
join key get a private one, so they never gather in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions import fields as R
from formweave.functions.dates import format_for_field
from formweave.functions.text import looks_like_consent, normalize_label, numeric_only, truncate
from formweave.functions.urls import has_placeholders, substitute_template
from formweave.operators.options import resolve_each, resolve_option
from formweave.operators.profiles import value_maps
from formweave.operators.retrieval import FUZZY_THRESHOLD, retrieve_answers
from formweave.operators.rule_tables import with_lexicon
from formweave.operators.spread import growing, spread
from formweave.schemas import DOCUMENT_ROLES
from formweave.session import checkpoint_dir

OPTION = "struct<value:string,text:string>"
DECISION = {
    "canonical": "string", "source": "string", "value": "string", "option": OPTION,
    "options_multi": f"array<{OPTION}>", "checked": "boolean", "document_id": "string",
    "confidence": "double", "action": "string", "reason": "string", "saved_answer_id": "string",
}
OPTION_KINDS = ["select", "radio_group", "aria_combobox", "aria_listbox"]
SET_IN_SETTINGS = "set this in Settings → Explicit answers to autofill it"
NO_MATCH = "no rule, token, lexicon or saved answer matched"
NO_TEMPLATE = "couldn't detect the company/role for your template answer"


def _decision(**given: Column) -> Column:
    cells = [
        given[name].cast(kind).alias(name) if name in given else F.expr(f"CAST(NULL AS {kind}) AS {name}")
        for name, kind in DECISION.items()
    ]
    return F.struct(*cells)


def _abstain(reason: Column, **given: Column) -> Column:
    return _decision(action=F.lit("abstain"), reason=reason, confidence=F.lit(0.0), **given)


def _review(reason: Column, **given: Column) -> Column:
    return _decision(action=F.lit("review"), reason=reason, confidence=F.lit(0.0), **given)


def match_keys(signals: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds norm, hidden, consent and the key a rule finds (rule_key, rule_source).

    `lexicon` is a table of rules (`rule_tables`) in place of the literal one.
    """
    label = F.coalesce(F.col("label"), F.lit(""))
    hidden = ~F.coalesce(F.col("visible"), F.lit(True))
    consent = (F.col("kind") == "checkbox") & looks_like_consent(label)
    columns = ["ats", "id_attr", "name_attr", "autocomplete", "norm", "section_norm", "kind"]
    rows = signals.withColumn("norm", normalize_label(label)).withColumn(
        "section_norm", normalize_label(F.coalesce(F.col("section_heading"), F.lit("")))
    )
    if lexicon is None:
        match = R.match_field(*columns)
    else:
        rows, match = with_lexicon(rows, lexicon), R.match_field(*columns, looked_up=F.col("lexicon_key"))
    return (
        rows.withColumn("hidden", hidden)
        .withColumn("consent", consent)
        .withColumn("_match", F.when(~hidden & ~consent, match))
        .withColumn("rule_key", F.col("_match.canonical"))
        .withColumn("rule_source", F.col("_match.source"))
        .drop("_match", "section_norm", "lexicon_key")
    )


def _own_key(wanted: Column) -> Column:
    """The join key, or one that matches nothing and spreads evenly."""
    return F.coalesce(wanted, F.concat(F.lit("\u0001"), F.pmod(F.xxhash64("page_id", "ref"), F.lit(1024))))


def attach_values(matched: DataFrame, profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds risk, the profile value of the key (p_*) and the stored document of a file field (doc).

    A candidate's values and documents are one row, and fields meet it in one
    join by candidate: they are sent once, and values are not unfolded.  Fields
    no rule knows join nothing; the fields of a candidate with very many of
    them are split by adaptive execution, which repeats the candidate's row.
    """
    key = F.col("rule_key")
    rows = matched.withColumn("risk", F.when(key.isNotNull(), R.risk_class(key))).withColumn(
        "is_file", key.isNotNull() & ((F.col("risk") == "file") | (F.col("kind") == "file"))
    )
    role = F.when(F.col("is_file"), F.when(key == "attachments.coverLetter", "coverLetter").otherwise("resume"))
    doc = F.struct(F.col("id"), F.col("file_name"), F.col("mime"))
    newest = lambda r: F.max_by(doc, F.when(F.col("role") == r, F.struct("added_us", "id"))).alias(f"doc_{r}")
    docs = documents.groupBy("cand").agg(*[newest(r) for r in DOCUMENT_ROLES])
    # files come as few splits, and values are dear to make; the join by candidate follows that shuffle
    kept = value_maps(spread(profiles, "cand")).join(docs, "cand", "full").withColumnRenamed("cand", "owner")
    value = F.when(~F.col("is_file"), F.col("by_key")[key])
    return (
        rows.withColumn("doc_role", role)
        .withColumn("owner", _own_key(F.when(key.isNotNull(), F.col("cand"))))
        .join(growing(kept), "owner", "left")
        .withColumns({
            "p_text": value["text"], "p_values": value["values"], "p_bool": value["bool_value"],
            "p_explicit": value["explicit"],
            "doc": F.coalesce(*[F.when(F.col("doc_role") == r, F.col(f"doc_{r}")) for r in DOCUMENT_ROLES]),
        })
        .drop("owner", "by_key", *[f"doc_{r}" for r in DOCUMENT_ROLES])
    )


def attach_answers(valued: DataFrame, answers: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Adds the saved answer (hit) of fields the rules left open and of salary fields without a value."""
    unresolved = ~F.col("hidden") & ~F.col("consent") & F.col("rule_key").isNull()
    unset_salary = ~F.col("is_file") & (F.col("risk") == "salary") & F.col("p_text").isNull()
    rows = valued.withColumn("asks", (F.col("norm") != "") & (unresolved | F.coalesce(unset_salary, F.lit(False))))
    questions = rows.filter("asks").select("cand", F.col("norm").alias("key"))
    stored = answers.select("cand", "id", "normalized_key", "answer")
    hits = (
        retrieve_answers(questions, answers, threshold)
        .join(growing(stored), ["cand", "id"])
        .select(
            "cand", F.col("key").alias("q_key"),
            F.struct("id", "normalized_key", "answer", "source", "score").alias("hit"),
        )
    )
    return (
        rows.withColumn("q_key", _own_key(F.when(F.col("asks"), F.col("norm"))))
        .join(growing(hits), ["cand", "q_key"], "left")
        .drop("q_key")
    )


def _file_decision() -> Column:
    key, source, doc = F.col("rule_key"), F.col("rule_source"), F.col("doc")
    accept = F.nullif(F.col("accept"), F.lit(""))
    score = R.confidence(source, F.lit("not-applicable"), F.lit(1.0))
    gate = R.gated(R.action_for(score), F.lit("file"), F.lit(False), F.lit(False))
    return (
        F.when(
            doc.isNull(),
            _abstain(F.concat(F.lit("no "), F.col("doc_role"), F.lit(" stored in your vault")), canonical=key),
        )
        .when(
            accept.isNotNull() & ~R.accept_allows(accept, doc["file_name"], doc["mime"]),
            _review(
                F.concat(
                    F.lit("form wants "), accept, F.lit(" but your "), F.col("doc_role"), F.lit(" is "), doc["file_name"]
                ),
                canonical=key, source=source, document_id=doc["id"],
            ),
        )
        .otherwise(
            _decision(
                canonical=key, source=source, document_id=doc["id"], value=doc["file_name"], confidence=score,
                action=gate["action"], reason=F.concat(F.lit("will attach "), doc["file_name"]),
            )
        )
    )


def decide(rows: DataFrame) -> DataFrame:
    """The decision for each row of attach_answers."""
    c = F.col
    hit, from_answer = c("hit"), c("hit").isNotNull()
    has_value = ~c("is_file") & c("p_text").isNotNull()
    scored = has_value | from_answer

    # what to put in: the profile value in the field's date order, or the answer with its template filled
    formatted = format_for_field(c("rule_key"), c("p_text"), c("kind"), c("placeholder"), c("date_format_hint"))
    filled = F.when(has_placeholders(hit["answer"]), substitute_template(hit["answer"], c("company"), c("role"))).otherwise(
        hit["answer"]
    )
    custom = F.coalesce(c("rule_key"), F.concat(F.lit("custom."), hit["normalized_key"]))
    staged = (
        rows.withColumn("s_key", F.when(from_answer, custom).otherwise(c("rule_key")))
        .withColumn("s_source", F.when(from_answer, hit["source"]).otherwise(c("rule_source")))
        .withColumn("desired", F.when(from_answer, filled).when(has_value, formatted))
        .withColumn("s_risk", R.risk_class(c("s_key")))
    )

    options = c("options")
    offers = F.coalesce(F.size(options), F.lit(0)) > 0
    is_multi = scored & (c("kind") == "multiselect") & offers
    is_option = scored & c("kind").isin(OPTION_KINDS) & offers
    wanted = F.when(~from_answer & c("p_values").isNotNull(), c("p_values")).otherwise(F.array("desired"))
    staged = (
        staged.withColumn("multi", F.when(is_multi & c("desired").isNotNull(), resolve_each(wanted, options)))
        .withColumn("single", F.when(is_option & c("desired").isNotNull(), resolve_option(c("desired"), options)))
        .withColumn("digits", F.when(scored & (c("kind") == "number") & ~is_multi & ~is_option, numeric_only(c("desired"))))
    )

    quality = F.coalesce(c("multi.quality"), c("single.quality"), F.lit("not-applicable"))
    retrieval = F.when(from_answer, hit["score"]).otherwise(F.lit(1.0))
    score = R.confidence(c("s_source"), quality, retrieval)
    explicit = ~from_answer & F.coalesce(c("p_explicit"), F.lit(False))
    staged = staged.withColumn("score", score).withColumn(
        "gate", R.gated(R.action_for(c("score")), c("s_risk"), explicit, from_answer)
    )

    base = {"canonical": c("s_key"), "source": c("s_source"), "saved_answer_id": hit["id"]}
    is_box = (c("kind") == "checkbox") & ~is_multi & ~is_option
    plain = ~is_multi & ~is_option & ~is_box & (c("kind") != "number")
    too_long = plain & (c("max_length") > 0) & (F.length("desired") > c("max_length"))
    texts = F.transform(c("multi.options"), lambda o: o["text"])
    value = (
        F.when(is_multi, F.array_join(texts, ", "))
        .when(c("digits").isNotNull(), c("digits"))
        .otherwise(c("desired"))
    )
    scored_decision = (
        F.when(from_answer & c("desired").isNull(), _review(F.lit(NO_TEMPLATE), value=hit["answer"], **base))
        .when(
            is_multi & c("multi").isNull(),
            _review(F.lit("none of your values match this field's options"), value=c("desired"), **base),
        )
        .when(
            is_option & c("single").isNull(),
            _review(
                F.concat(F.lit('"'), truncate(c("desired")), F.lit("\" is not among this field's options")),
                value=c("desired"), **base,
            ),
        )
        .when(
            is_box & (from_answer | c("p_bool").isNull()),
            _review(F.lit("checkbox needs a yes/no answer"), canonical=c("s_key"), source=c("s_source"), value=c("desired")),
        )
        .when(c("digits") == "", _review(F.lit("this field needs a number"), value=c("desired"), **base))
        .when(
            too_long,
            _review(
                F.concat(F.lit("answer exceeds the field's "), c("max_length"), F.lit("-character limit")),
                value=c("desired"), **base,
            ),
        )
        .otherwise(
            _decision(
                value=value, option=c("single.option"), options_multi=c("multi.options"),
                checked=F.when(is_box, c("p_bool")), confidence=c("score"), action=c("gate.action"),
                reason=F.coalesce(c("gate.reason"), R.reason_for(c("s_source"), quality)), **base,
            )
        )
    )
    decision = (
        F.when(c("hidden"), _abstain(F.lit("field not visible")))
        .when(c("consent"), _review(F.lit(R.CONSENT_REASON)))
        .when(c("is_file"), _file_decision())
        .when(scored, scored_decision)
        .when(
            c("rule_key").isNotNull() & c("risk").isin("eeo", "legal", "salary"),
            _review(F.lit(SET_IN_SETTINGS), canonical=c("rule_key"), source=c("rule_source")),
        )
        .when(
            c("rule_key").isNotNull(),
            _abstain(F.concat(F.lit("no profile value for "), c("rule_key")), canonical=c("rule_key")),
        )
        .otherwise(_abstain(F.lit(NO_MATCH)))
    )
    return staged.withColumn("_d", decision).select("cand", "page_id", "ref", "_d.*")


def map_fields(
    signals: DataFrame, profiles: DataFrame, answers: DataFrame, documents: DataFrame,
    threshold: float = FUZZY_THRESHOLD, lexicon: DataFrame | None = None,
) -> DataFrame:
    """Decisions for all signals: rules, values, answers, options, score and gates.

    `lexicon` is a table of label rules of any size in place of the literal one.

    Fields with their keys and values are read several times by the lookup of
    answers, and the rules are dear, so they are written once by a checkpoint in
    the session's shared folder.
    """
    checkpoint_dir(signals.sparkSession)
    needed = signals.drop("elements", "selector_keys", "member_selectors", "selector")
    valued = attach_values(match_keys(needed, lexicon), profiles, documents).checkpoint()
    return decide(attach_answers(valued, answers, threshold))
