"""Recall and precision of decisions against golden labels.

golden: page_id, url, fields (array of selector, canonical, ...), expect_no_fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.selectors import element_keys, is_simple, lookup_key, passes, selector_tests
from formweave.functions.urls import detect_ats
from formweave.operators.spread import growing

GATES = {"recall": 0.95, "precision": 0.98}


def labelled_fields(golden: DataFrame) -> DataFrame:
    """One row per label; must-not-fill selectors have no canonical."""
    base = ["page_id", detect_ats(F.col("url")).alias("ats")]
    wanted = golden.select(*base, F.posexplode("fields").alias("i", "f")).select(
        "page_id", "ats", "i", F.col("f.selector").alias("selector"), F.col("f.canonical").alias("expected")
    )
    forbidden = golden.select(*base, F.posexplode("expect_no_fill").alias("i", "selector")).select(
        "page_id", "ats", "i", "selector", F.lit(None).cast("string").alias("expected")
    )
    return wanted.unionByName(forbidden)


def _selector_owners(labels: DataFrame, signals: DataFrame) -> DataFrame:
    """(page_id, selector, ref): the first field in document order that a label's selector names.

    A simple selector is tested on the attributes of all elements that share
    one value or attribute with it; any other is compared with the spellings
    a field is known by.
    """
    asked = labels.select("page_id", "selector").distinct()
    element = signals.select("page_id", "ref", F.explode("elements").alias("e")).select(
        "page_id", "ref", "e.pos", "e.attrs", F.explode(F.array_distinct(element_keys(F.col("e.attrs")))).alias("key")
    )
    tested = (
        asked.filter(is_simple(F.col("selector"))).withColumn("tests", selector_tests(F.col("selector")))
        .withColumn("key", lookup_key(F.col("tests"))).join(growing(element), ["page_id", "key"])
        .filter(F.forall("tests", lambda t: passes(t, F.col("attrs"))))
    )
    spelt = signals.select("page_id", "ref", "pos", F.explode("selector_keys").alias("selector")).join(growing(asked), ["page_id", "selector"])
    named = ["page_id", "selector", "ref", "pos"]
    return tested.select(named).unionByName(spelt.select(named)).groupBy("page_id", "selector").agg(F.min_by("ref", "pos").alias("ref"))


def judge(golden: DataFrame, signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per label: detected, filled, correct, forbidden and the mistake, if any."""
    c = F.col
    labels = labelled_fields(golden)
    rows = (
        labels.join(growing(_selector_owners(labels, signals)), ["page_id", "selector"], "left")
        .join(growing(decisions.select("page_id", "ref", "canonical", "value", "action")), ["page_id", "ref"], "left")
    )
    is_label = c("expected").isNotNull()
    filled = F.coalesce(c("action").isin("fill", "fill-amber"), F.lit(False))
    correct = is_label & filled & F.coalesce(c("canonical") == c("expected"), F.lit(False))
    shown = lambda x: F.coalesce(x, F.lit("∅"))
    mistake = (
        F.when(is_label & c("ref").isNull(), F.concat(F.lit("MISSED "), c("selector"), F.lit(" ("), c("expected"), F.lit(")")))
        .when(
            is_label & filled & ~correct,
            F.concat(F.lit("WRONG "), c("selector"), F.lit(": mapped to "), shown(c("canonical")), F.lit(" (wanted "),
                     c("expected"), F.lit('), value="'), shown(c("value")), F.lit('"')),
        )
        .when(~is_label & filled, F.concat(F.lit("FORBIDDEN FILL "), c("selector"), F.lit(": "), shown(c("canonical")),
                                            F.lit(' = "'), shown(c("value")), F.lit('"')))
    )
    return rows.select(
        "page_id", "ats", "i", "selector", is_label.alias("is_label"), (is_label & c("ref").isNotNull()).alias("detected"),
        filled.alias("filled"), correct.alias("correct"), (~is_label & filled).alias("forbidden"), mistake.alias("mistake"),
    )


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def scores(judged: DataFrame) -> DataFrame:
    """Counts and rates per page, per board and overall (null page_id, null ats) in one pass."""
    count = lambda name: F.count_if(F.col(name)).alias(name)
    return (
        judged.rollup("ats", "page_id")
        .agg(count("is_label"), count("detected"), count("filled"), count("correct"), count("forbidden"))
        .withColumnRenamed("is_label", "labels")
        .withColumn("recall", _rate("detected", "labels"))
        .withColumn("precision", _rate("correct", "filled"))
    )


def mistakes(judged: DataFrame) -> DataFrame:
    return judged.filter("mistake IS NOT NULL").select("page_id", "selector", "mistake")


def gates(scored: DataFrame) -> DataFrame:
    """The overall row with pass flags for the three release gates."""
    overall = scored.filter("ats IS NULL AND page_id IS NULL")
    return overall.select(
        "recall", "precision", "forbidden",
        (F.col("recall") > GATES["recall"]).alias("recall_ok"),
        F.coalesce(F.col("precision") > GATES["precision"], F.lit(False)).alias("precision_ok"),
        (F.col("forbidden") == 0).alias("forbidden_ok"),
    )
