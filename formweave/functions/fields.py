"""Rules that look at one form field: canonical keys, risk, confidence, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formweave.functions.literals import string_map
from formweave.functions.text import WS, tokens_of, trim_ws
from formweave.rules.hosts import AdapterRule, adapter_rules
from formweave.rules.lexicon import LexiconEntry, autocomplete_tokens, lexicon

# Weights, tiers, bands and wording of decisions.
RULE_TIERS = {"adapter": 1.0, "autocomplete": 0.95, "lexicon": 0.8, "answer-exact": 0.9, "answer-fuzzy": 0.65}
WEIGHT_TIER, WEIGHT_OPTION, WEIGHT_RETRIEVAL = 0.45, 0.30, 0.25
OPTION_SCORES = {"exact": 1.0, "not-applicable": 1.0, "substring": 0.5, "none": 0.0}
BANDS = [(0.9, "fill"), (0.7, "fill-amber"), (0.5, "review")]
REASONS = {
    "adapter": "matched a known field on this job board",
    "autocomplete": "matched the field's autocomplete token",
    "lexicon": "matched the field label",
    "answer-exact": "you answered this exact question before",
    "answer-fuzzy": "similar to a question you answered before",
}
GATE_REASONS = {
    "eeo": "EEO answers fill only from your explicit settings",
    "legal": "legal answers fill only from your explicit settings",
    "salary": "salary fills only from an explicit setting or saved answer",
}
CONSENT_REASON = "consent checkboxes always need you"
LEGAL_KEYS = ["preferences.workAuth", "preferences.requiresSponsorship"]
SALARY_KEYS = ["preferences.salary", "preferences.salaryMin", "preferences.salaryMax"]
# end of fixed values


def _cases(branches: list[tuple[str, str]]) -> Column:
    """First-match rules as one CASE expression: one round trip to the JVM instead of hundreds."""
    return F.expr("CASE " + " ".join(f"WHEN {test} THEN '{key}'" for test, key in branches) + " END")


def adapter_key(ats: str, id_attr: str, name_attr: str, rules: list[AdapterRule] | None = None) -> Column:
    """Key of the first rule of the board whose id or name pattern matches; arguments are column names."""
    branches = []
    for r in rules or adapter_rules():
        tests = [f"coalesce({c} RLIKE r'{p}', false)" for c, p in ((id_attr, r.id_re), (name_attr, r.name_re)) if p]
        branches.append((f"{ats} = '{r.ats}' AND ({' OR '.join(tests)})", r.key))
    return _cases(branches)


def autocomplete_key(token: Column, table: dict[str, str] | None = None) -> Column:
    """Key of the last known word of the autocomplete attribute."""
    known = string_map(table or autocomplete_tokens())
    words = F.reverse(F.split(trim_ws(F.lower(token)), f"{WS}+"))
    return F.get(F.array_compact(F.transform(words, lambda w: F.element_at(known, w))), F.lit(0))


def lexicon_key(norm: str, section: str, entries: list[LexiconEntry] | None = None) -> Column:
    """First lexicon entry that fits a normalised label under a normalised section heading.

    Arguments are names of columns already computed: the entries look at them
    some two hundred times.
    """
    any_of = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    branches = []
    for e in entries or lexicon():
        tests = []
        if e.exact:
            tests.append(f"{norm} IN ({', '.join(repr(w) for w in e.exact)})")
        if e.contains:
            tests.append(any_of(norm, e.contains))
        hit = f"({' OR '.join(tests)})"
        branches.append((f"{hit} AND {any_of(section, e.section_any)}" if e.section_any else hit, e.key))
    return F.when(F.col(norm) != "", _cases(branches))


def file_key(kind: Column, norm: Column) -> Column:
    """File inputs by word: 'cv' is too short to be looked for inside other words."""
    has = lambda w: F.array_contains(tokens_of(norm), w)
    return F.when((kind == "file") & has("cover"), F.lit("attachments.coverLetter")).when(
        (kind == "file") & (has("resume") | has("cv") | has("résumé")), F.lit("attachments.resume")
    )


def match_field(
    ats: str, id_attr: str, name_attr: str, autocomplete: str, norm: str, section_norm: str, kind: str,
    looked_up: Column | None = None,
) -> Column:
    """struct(canonical, source) of the first tier that knows the field; arguments are column names.

    `looked_up` is the lexicon's key where a rule table has found it already.
    """
    tiers = [
        (adapter_key(ats, id_attr, name_attr), "adapter"),
        (autocomplete_key(F.col(autocomplete)), "autocomplete"),
        (lexicon_key(norm, section_norm) if looked_up is None else looked_up, "lexicon"),
        (file_key(F.col(kind), F.col(norm)), "lexicon"),
    ]
    return F.coalesce(
        *[F.when(k.isNotNull(), F.struct(k.alias("canonical"), F.lit(s).alias("source"))) for k, s in tiers]
    )


def risk_class(key: Column) -> Column:
    return (
        F.when(key.startswith("eeo."), "eeo")
        .when(key.isin(LEGAL_KEYS), "legal")
        .when(key.isin(SALARY_KEYS), "salary")
        .when(key.startswith("attachments."), "file")
        .otherwise("normal")
    )


def _by_name(c: Column, table: dict) -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(c == k, F.lit(v))
    return chain.otherwise(F.lit(None))


def confidence(source: Column, option_quality: Column, retrieval: Column) -> Column:
    """Weighted score, half up to three decimals."""
    base = (
        WEIGHT_TIER * F.coalesce(_by_name(source, RULE_TIERS), F.lit(0.0))
        + WEIGHT_OPTION * _by_name(option_quality, OPTION_SCORES)
        + WEIGHT_RETRIEVAL * retrieval
    )
    return F.floor(base * 1000 + 0.5) / 1000


def action_for(score: Column) -> Column:
    chain = F
    for floor, action in BANDS:
        chain = chain.when(score >= floor, F.lit(action))
    return chain.otherwise(F.lit("abstain"))


def gated(action: Column, risk: Column, explicit: Column, from_answer: Column) -> Column:
    """struct(action, reason): hard gates over the scored action; reason only when a gate sends to review."""
    needs_explicit = risk.isin("eeo", "legal") & ~explicit
    needs_source = (risk == "salary") & ~explicit & ~from_answer
    never_silent = F.when((action == "fill") & (risk != "normal"), F.lit("fill-amber")).otherwise(action)
    blocked = needs_explicit | needs_source
    return F.struct(
        F.when(blocked, F.lit("review")).otherwise(never_silent).alias("action"),
        F.when(blocked, _by_name(risk, GATE_REASONS)).alias("reason"),
    )


def reason_for(source: Column, option_quality: Column) -> Column:
    closest = F.when(option_quality == "substring", F.lit(" (closest option)")).otherwise(F.lit(""))
    return F.concat(_by_name(source, REASONS), closest)


def accept_allows(accept: Column, file_name: Column, mime: Column) -> Column:
    """Does an accept attribute permit this file?  An empty list permits all."""
    parts = F.array_remove(F.transform(F.split(accept, ","), lambda p: F.lower(trim_ws(p))), "")
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split(file_name, r"\."), -1)))
    kind = F.lower(mime)
    fits = lambda p: (
        F.when(p.startswith("."), p == ext)
        .when(p.endswith("/*"), F.startswith(kind, F.regexp_replace(p, r"\*$", "")))
        .otherwise(p == kind)
    )
    return (F.size(parts) == 0) | F.exists(parts, fits)
