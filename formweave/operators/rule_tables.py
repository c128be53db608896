"""The label lexicon as a table of any size.

rules: ord, key, exact, contains, section_any, as in `rules.lexicon`.  The
literal form (`functions.fields.lexicon_key`) tests every entry on every row
and stands in the plan whole; here labels meet only the phrases they can
contain, and of all entries that fit the lowest ord wins.

A table of up to `FEW_BYTES` goes to every task, beside its first row, and
labels are looked up where they are (`operators.rule_search`): nothing is
sent.  Its size is the one thing that is measured while the plan is built.

With a larger one distinct labels meet phrases by a join
(`operators.containment`).  A label gets its first entry for any section and,
in order, the earlier ones that ask for a section word; its rows test these on
their own headings, so a heading is sent once, beside its row.  Labels are
known by 128 bits of hashes where their rows are brought together.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from formweave.operators import containment, rule_search
from formweave.operators.containment import beside_first, candidates, number_of, numbered
from formweave.operators.spread import growing
from formweave.rules.lexicon import LexiconEntry, lexicon

# executors need not have the package
for _module in (containment, rule_search):
    cloudpickle.register_pickle_by_value(_module)

#: Bytes of entries that are sent to every task; more are joined.
FEW_BYTES = 4_000_000
RULES = "ord long, key string, exact array<string>, contains array<string>, section_any array<string>"


def lexicon_table(spark: SparkSession, entries: list[LexiconEntry] | None = None) -> DataFrame:
    """The literal lexicon, or entries in their order, as rules."""
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries or lexicon())], RULES)


def _gates(rules: DataFrame, spellings: str) -> DataFrame:
    """(phrase, word, rule): the first rule of a phrase under a section word, or under any section where word is null."""
    return (
        rules.select("ord", "key", "section_any", F.explode(spellings).alias("phrase"))
        .select("phrase", F.explode_outer("section_any").alias("word"), F.struct("ord", "key").alias("rule"))
        .filter("phrase <> '' AND (word IS NULL OR word <> '')")
        .groupBy("phrase", "word").agg(F.min("rule").alias("rule"))
    )


def _entries(rules: DataFrame) -> DataFrame:
    """(rule, phrase, whole, word): all a label is tested for."""
    some = lambda spellings, whole: _gates(rules, spellings).select("rule", "phrase", F.lit(whole).alias("whole"), "word")
    return some("contains", False).unionByName(some("exact", True))


def _are_few(rules: DataFrame) -> bool:
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("phrase", "word", "rule.key")), F.lit(32))
    return (_entries(rules).agg(F.sum(size)).first()[0] or 0) <= FEW_BYTES


def _looked_up(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with lexicon_key, found in the tasks where they are."""
    listed = _entries(rules).agg(F.sort_array(F.collect_list(F.struct("rule", "phrase", "whole", "word"))).alias("all"))
    entries = listed.select(
        F.transform("all", lambda x: F.struct(x["rule"]["key"].alias("key"), x["phrase"].alias("phrase"), x["whole"].alias("whole"), x["word"].alias("word")))
    ).scalar()
    keys = F.arrow_udf(rule_search.first_keys, "string")
    return rows.withColumn("_entries", beside_first(entries)).withColumn("lexicon_key", keys("norm", "section_norm", "_entries")).drop("_entries")


def _label_rules(norms: DataFrame, rules: DataFrame) -> DataFrame:
    """(_n1, _n2, _free, _gated): of each label that a rule fits its first rule for any section, and the ones before that as (rule, word), in order."""
    group = F.lit(0).alias("grp")
    texts = numbered(norms.select(group, F.col("norm").alias("text")))
    by_phrase = lambda spellings: _gates(rules, spellings).groupBy("phrase").agg(
        F.collect_list(F.struct("rule", "word")).alias("gates")
    ).select(group, "phrase", "gates")
    parts = candidates(texts, by_phrase("contains")).select("a", "phrase", "gates", F.lit(False).alias("whole"))
    names = by_phrase("exact").select(number_of(F.col("grp"), F.col("phrase")).alias("a"), "phrase", "gates", F.lit(True).alias("whole"))
    met = texts.join(growing(parts.unionByName(names)), "a")
    fit = F.when(F.col("whole"), F.col("text") == F.col("phrase")).otherwise(F.contains("text", "phrase"))
    hits = met.filter(fit).select("a", *_label_id(F.col("text")), F.explode("gates").alias("gate"))
    word = F.col("gate.word")
    best = hits.groupBy("a", "_n1", "_n2").agg(
        F.min(F.when(word.isNull(), F.col("gate.rule"))).alias("_free"), F.collect_set(F.when(word.isNotNull(), F.col("gate"))).alias("_gated")
    )
    earlier = F.filter("_gated", lambda g: F.col("_free").isNull() | (g["rule"] < F.col("_free")))
    return best.select("_n1", "_n2", "_free", F.sort_array(earlier).alias("_gated"))


def _label_id(norm: Column) -> list[Column]:
    return [F.xxhash64(norm).alias("_n1"), F.xxhash64(F.lit(1), norm).alias("_n2")]


def _first_rule(section: Column) -> Column:
    fitting = F.filter("_gated", lambda g: F.contains(section, g["word"]))
    return F.coalesce(F.get(fitting, F.lit(0))["rule"], F.col("_free"))


def lexicon_keys(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """(norm, section_norm, key): the key of the first rule that fits a label under its section heading.

    labels: norm, section_norm, both normalised; rows may repeat, each distinct
    pair that a rule fits comes out once.  A rule fits a label that is one of
    `exact` or contains one of `contains`, under a heading that contains one of
    `section_any`, if there are any.  Empty or null labels, spellings and
    section words fit nothing; a null heading is an empty one.  Of rules with
    one ord the smaller key wins.
    """
    asked = (
        labels.filter("norm <> ''")
        .select("norm", F.coalesce("section_norm", F.lit("")).alias("section_norm")).distinct()
    )
    if _are_few(rules):
        return _looked_up(asked, rules).filter("lexicon_key IS NOT NULL").select("norm", "section_norm", F.col("lexicon_key").alias("key"))
    found = asked.select("*", *_label_id(F.col("norm"))).join(growing(_label_rules(asked.select("norm"), rules)), ["_n1", "_n2"])
    first = found.select("norm", "section_norm", _first_rule(F.col("section_norm")).alias("rule"))
    return first.filter("rule IS NOT NULL").select("norm", "section_norm", "rule.key")


def with_lexicon(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds lexicon_key to rows with norm and section_norm; rows without a label join nothing and stay spread."""
    if _are_few(rules):
        return _looked_up(fields, rules)
    found = _label_rules(fields.select("norm"), rules)
    # the same for a row that is made again after an executor was lost
    plain = [f.name for f in fields.schema if isinstance(f.dataType, AtomicType)]
    own = F.pmod(F.xxhash64(*plain), F.lit(1024))
    n1, n2 = _label_id(F.col("norm"))
    asks = F.col("norm") != ""
    return (
        fields.withColumn("_n1", F.when(asks, n1).otherwise(own))
        .withColumn("_n2", F.when(asks, n2).otherwise(F.lit(None)))
        .withColumn("_section", F.coalesce("section_norm", F.lit("")))
        .join(growing(found), ["_n1", "_n2"], "left")
        .withColumn("lexicon_key", _first_rule(F.col("_section"))["key"])
        .drop("_n1", "_n2", "_section", "_free", "_gated")
    )
