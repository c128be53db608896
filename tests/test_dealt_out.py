"""Rows that are dear to process are dealt out, however few splits they come in; pages as lines."""

from __future__ import annotations

from formweave.operators import cv as C
from formweave.operators.option_lists import resolve_in_lists
from formweave.plans import texts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df, key: str) -> list[str]:
    return [line for line in plan_of(df).splitlines() if "REPARTITION_BY_NUM" in line and f"hashpartitioning({key}" in line]


def test_customers_are_dealt_out_before_their_options_are_resolved(spark, tmp_path):
    rows = [(1, 0, "BUILDING"), (2, 1, "MACHINERY"), (2, 2, None), (None, 3, "HOUSEHOLD")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = texts.option_resolution(spark, str(tmp_path))
    assert dealt(found, "c_custkey")
    assert sorted(((r.c_custkey, r.segment, r.country) for r in found.collect()), key=str) == [
        (1, "1", "x"), (2, "4", "DE"), (2, None, "GB"), (None, None, "ZA")
    ]


def test_options_are_dealt_out_before_their_forms_are_made(spark):
    options = spark.createDataFrame([("l", 0, "g", "Germany"), ("l", 1, "f", "France")], "list_id string, pos int, value string, text string").coalesce(1)
    wanted = spark.createDataFrame([("l", "Deutschland")], "list_id string, desired string")
    found = resolve_in_lists(wanted, options)
    assert dealt(found, "list_id")
    assert [(r.desired, r.option.value, r.quality) for r in found.collect()] == [("Deutschland", "g", "exact")]


def test_items_of_odd_heights_and_blank_items(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("b", 1.0, -8.0), ("a", 0.0, -8.0), ("c", 0.0, -11.0), ("d", 0.0, -12.5), ("e", 2.0, nan), ("f", 3.0, nan), ("g", 0.0, None),
            ("h", 1.0, None), ("i", 0.0, inf), ("j", 1.0, inf), ("\u00a0 \u3000", 5.0, -8.0), (None, 5.0, -8.0)]
    items = spark.createDataFrame([(1, 0, s, x, y, i) for i, (s, x, y) in enumerate(rows)], "doc_id long, page int, str string, x double, y double, i int")
    assert C.text_from_items(items).first().text.split("\n") == ["g", "h", "i", "j", "a b c", "d", "e", "f"]
