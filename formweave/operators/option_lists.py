"""Wanted values against option lists of any length, as joins.

The rows form of `operators.options`: a list is rows (list_id, pos, value,
text) kept once however many fields offer it, and a wanted value meets only
the options that share a meaning, a window of characters or its rarest word
with it.  What the array form decides by looking at a whole list, that there
is just one option, is a count here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import meaning_keys, normalize_label, tokens_of
from formweave.operators.containment import contained_pairs
from formweave.operators.options import prepared
from formweave.operators.spread import spread


def _first() -> Column:
    return F.min(F.struct("pos", "option"))


def _by_meaning(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(list_id, desired, meant): the first option that shares a key with the value."""
    keyed = offered.select("list_id", "pos", "option", F.explode("keys").alias("key"))
    first = keyed.groupBy("list_id", "key").agg(_first().alias("first"))
    wanted = asked.select("list_id", "desired", F.explode(F.array_distinct("keys")).alias("key"))
    found = wanted.join(first, ["list_id", "key"]).groupBy("list_id", "desired").agg(F.min("first").alias("first"))
    return found.select("list_id", "desired", F.col("first.option").alias("meant"))


def _by_part(norms: DataFrame, offered: DataFrame) -> DataFrame:
    """(list_id, norm, part): the only option that contains the value or is contained in it."""
    shown = offered.filter("norm <> ''").groupBy("list_id", F.col("norm").alias("shown")).agg(
        F.count("*").alias("n"), _first().alias("first")
    )
    side = lambda df, c, name: df.select(F.col("list_id").alias("grp"), F.col(c).alias(name))
    inside = contained_pairs(side(shown, "shown", "text"), side(norms, "norm", "phrase")).select(
        F.col("grp").alias("list_id"), F.col("text").alias("shown"), F.col("phrase").alias("norm")
    )
    around = contained_pairs(side(norms, "norm", "text"), side(shown, "shown", "phrase")).filter("text <> phrase").select(
        F.col("grp").alias("list_id"), F.col("phrase").alias("shown"), F.col("text").alias("norm")
    )
    met = inside.unionByName(around).join(shown, ["list_id", "shown"])
    found = met.groupBy("list_id", "norm").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return found.filter("n = 1").select("list_id", "norm", F.col("first.option").alias("part"))


def _by_words(norms: DataFrame, offered: DataFrame) -> DataFrame:
    """(list_id, norm, worded): the only option that has all words of the value."""
    shown = offered.select("list_id", "pos", "option", F.col("words").alias("has"), F.explode("words").alias("word"))
    counts = shown.groupBy("list_id", "word").agg(F.count("*").alias("n"))
    wanted = norms.select("list_id", "norm", F.explode(tokens_of(F.col("norm"))).alias("word"))
    rarest = (
        wanted.join(counts, ["list_id", "word"], "left")
        .groupBy("list_id", "norm").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest"))
        .filter("rarest.n > 0").select("list_id", "norm", F.col("rarest.word").alias("word"))
    )
    all_words = F.size(F.array_except(tokens_of(F.col("norm")), F.col("has"))) == 0
    found = rarest.join(shown, ["list_id", "word"]).filter(all_words).groupBy("list_id", "norm").agg(
        F.count("*").alias("n"), _first().alias("first")
    )
    return found.filter("n = 1").select("list_id", "norm", F.col("first.option").alias("worded"))


def resolve_in_lists(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """(list_id, desired, option, quality): each distinct wanted value that its list resolves, once.

    wanted: list_id, desired; options: list_id, pos, value, text.  An option of
    the same meaning is exact, the first by pos; else the only one that
    contains or is contained in the value, else the only one with all its
    words, is a substring match.  Null or wordless values, null list ids and
    lists without options resolve to nothing; of options with one pos the
    smaller (value, text) counts as first.

    A value that stands in many options makes a row with each of them before
    they are counted: at most its list, never lists times values.
    """
    shape = F.get(prepared(F.array(F.struct("value", "text"))), F.lit(0))
    # the forms of an option are dear to make, and a list may come as one split
    dealt = spread(options.filter("list_id IS NOT NULL").select("list_id", "pos", "value", "text"), "list_id", "pos", "value", "text")
    offered = dealt.select("list_id", "pos", shape.alias("o")).select("list_id", "pos", "o.*")
    asked = (
        wanted.filter("list_id IS NOT NULL").select("list_id", "desired").distinct()
        .withColumn("norm", normalize_label(F.col("desired"))).filter("norm <> ''")
        .withColumn("keys", meaning_keys(F.col("desired")))
    )
    norms = asked.select("list_id", "norm").distinct()
    return (
        asked.drop("keys")
        .join(_by_meaning(asked, offered), ["list_id", "desired"], "left")
        .join(_by_part(norms, offered), ["list_id", "norm"], "left")
        .join(_by_words(norms, offered), ["list_id", "norm"], "left")
        .select(
            "list_id", "desired", F.coalesce("meant", "part", "worded").alias("option"),
            F.when(F.col("meant").isNotNull(), "exact").otherwise("substring").alias("quality"),
        )
        .filter("option IS NOT NULL")
    )


def resolve_each_in_lists(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """(field, options, quality): for lists of wanted values, as `options.resolve_each`.

    wanted: field, list_id, desired (an array).  Fields none of whose values
    match are left out; options without a value are found but not kept.
    """
    each = wanted.select("field", "list_id", F.posexplode("desired").alias("at", "desired"))
    found = each.join(resolve_in_lists(each, options), ["list_id", "desired"])
    value = F.col("option.value")
    once = found.groupBy("field", value.alias("value")).agg(
        F.min(F.struct("at", "option")).alias("first"), F.bool_and(F.col("quality") == "exact").alias("exact")
    )
    kept = F.collect_list(F.when(F.col("value").isNotNull(), F.col("first")))
    return once.groupBy("field").agg(
        F.transform(F.sort_array(kept), lambda f: f["option"]).alias("options"),
        F.when(F.bool_and("exact"), "exact").otherwise("substring").alias("quality"),
    )
