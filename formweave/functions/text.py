"""Label normalisation, similarity and meaning keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from formweave.functions.literals import lookup, string_map
from formweave.rules import meanings

# Java's \s is ASCII only; form text also carries no-break and wide spaces.
WS = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# ASCII word boundaries: \b also looks at accented letters on some JVMs
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize_label(c: Column) -> Column:
    """Lower case, no required/optional marker, letters and digits only."""
    bare = F.regexp_replace(F.lower(c), r"\(required\)|\(optional\)", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def tokens_of(norm: Column) -> Column:
    """Distinct words of an already normalised string."""
    return F.array_distinct(F.array_remove(F.split(norm, " "), ""))


def trigrams_of(norm: Column) -> Column:
    """Distinct 3-character windows of ' norm '; the lookahead steps one character at a time."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def set_jaccard(a: Column, b: Column) -> Column:
    sets = F.struct(a.alias("a"), b.alias("b"), F.size(F.array_intersect(a, b)).alias("both"))
    ratio = lambda s: s["both"] / (F.size(s["a"]) + F.size(s["b"]) - s["both"])
    return bind(
        sets, lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(ratio(s))
    )


def _jaccard_of(a: Column, b: Column, elements) -> Column:
    both = F.struct(elements(a).alias("a"), elements(b).alias("b"))
    return bind(both, lambda s: set_jaccard(s["a"], s["b"]))


def token_jaccard(a: Column, b: Column) -> Column:
    return _jaccard_of(a, b, tokens_of)


def trigram_jaccard(a: Column, b: Column) -> Column:
    return _jaccard_of(a, b, trigrams_of)


def fuzzy_score(a: Column, b: Column) -> Column:
    return F.greatest(token_jaccard(a, b), trigram_jaccard(a, b))


def fold_place(c: Column) -> Column:
    """Place-name key: lower case, accents removed, other characters to spaces."""
    src, dst = meanings.mark_folding()
    plain = F.translate(F.lower(c), src, dst)
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def alias_group(c: Column) -> Column:
    groups = {k: str(v) for k, v in meanings.alias_groups().items()}
    return F.element_at(string_map(groups), normalize_label(c)).cast("int")


def country_key(c: Column) -> Column:
    return F.element_at(string_map(meanings.country_aliases()), fold_place(c))


def state_key(c: Column) -> Column:
    return F.element_at(string_map(meanings.state_aliases()), fold_place(c))


def dial_for_country(c: Column) -> Column:
    return F.element_at(string_map(meanings.country_dials()), country_key(c))


def dial_from_phone(c: Column) -> Column:
    """Longest known dial code of an international number."""
    bare = F.regexp_replace(c, f"[{WS[1:-1]}().-]", "")
    digits = F.regexp_extract(bare, r"^(?:\+|00)(\d{1,4})", 1)
    known = sorted(set(meanings.country_dials().values()))
    prefixes = [F.substring(digits, 1, n) for n in (4, 3, 2, 1)]
    return F.coalesce(*[F.when(p.isin(known), p) for p in prefixes])


def meaning_variants(c: Column) -> Column:
    """Normal form with and without parenthesised parts, empty ones left out."""
    bare = F.regexp_replace(c, r"\([^)]*\)", " ")
    return F.array_remove(F.array_distinct(F.array(normalize_label(c), normalize_label(bare))), "")


def meaning_keys(c: Column) -> Column:
    """Keys such that two strings mean the same iff they share one.

    t: text, a: alias group, c: country, s: state.  The relation is not
    transitive, so a string keeps all its keys and is never reduced to one.
    """
    aliases = {k: [f"a:{v}"] for k, v in meanings.alias_groups().items()}
    places: dict[str, list[str]] = {k: [f"c:{v}"] for k, v in meanings.country_aliases().items()}
    for spelling, region in meanings.state_aliases().items():
        places.setdefault(spelling, []).append(f"s:{region}")
    none = F.array().cast("array<string>")
    per_variant = F.transform(
        meaning_variants(c),
        lambda v: F.concat(
            F.array(F.concat(F.lit("t:"), v)),
            F.coalesce(lookup(aliases, v), none),
            F.coalesce(lookup(places, fold_place(v)), none),
        ),
    )
    return F.flatten(per_variant)


def same_meaning(a: Column, b: Column) -> Column:
    return F.arrays_overlap(meaning_keys(a), meaning_keys(b))


def looks_like_consent(label: Column) -> Column:
    return label.rlike(
        rf"(?i){WORD_START}(i (agree|consent|certify|acknowledge|confirm|accept)|terms (and|&) conditions"
        rf"|privacy (policy|notice)|by (checking|submitting)){WORD_END}"
    )


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(https?|chrome(-extension)?|file)://[^\s" + WS[3:-1] + r"]+", "<url>")


def truncate(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_required_markers(c: Column) -> Column:
    unmarked = F.regexp_replace(c, r"(?i)\(required\)|\(optional\)", "")
    return trim_ws(F.regexp_replace(unmarked, f"[*✱]{WS}*$", ""))


def clean_label(c: Column) -> Column:
    """Collapsed text capped at 240 characters, without required markers."""
    return strip_required_markers(F.substring(collapse(F.coalesce(c, F.lit(""))), 1, 240))


def humanize_name(c: Column) -> Column:
    """`billingCity[0]_x` -> words."""
    spaced = F.regexp_replace(c, r"[\[\]_-]+", " ")
    return trim_ws(F.regexp_replace(spaced, r"([a-z])([A-Z])", "$1 $2"))


def numeric_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.]", "")


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar functions as temporary SQL functions, inlined by the analyzer."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_label(s STRING) RETURNS STRING RETURN "
        r"trim(regexp_replace(regexp_replace(lower(s), r'\(required\)|\(optional\)', ' '), "
        r"r'[^\p{L}\p{N}]+', ' '))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION label_tokens(s STRING) RETURNS ARRAY<STRING> RETURN "
        "array_distinct(array_remove(split(normalize_label(s), ' '), ''))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION label_trigrams(s STRING) RETURNS ARRAY<STRING> RETURN "
        "array_distinct(regexp_extract_all(concat(' ', normalize_label(s), ' '), r'(?s)(?=(.{3}))', 1))"
    )
    for name, part in (("token_jaccard", "label_tokens"), ("trigram_jaccard", "label_trigrams")):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS DOUBLE RETURN "
            f"CASE WHEN size({part}(a)) = 0 OR size({part}(b)) = 0 THEN 0D ELSE "
            f"size(array_intersect({part}(a), {part}(b))) / size(array_union({part}(a), {part}(b))) END"
        )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fuzzy_score(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "greatest(token_jaccard(a, b), trigram_jaccard(a, b))"
    )
