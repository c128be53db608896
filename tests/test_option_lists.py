"""Option lists as rows against the array form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from formweave.operators.option_lists import resolve_each_in_lists, resolve_in_lists
from formweave.operators.options import resolve_each, resolve_option

OPTIONS = "list_id string, pos int, value string, text string"
OFFERED = "list_id string, options array<struct<value:string,text:string>>"


def _lists():
    """One list of 5,000 options and small ones with places, repeats, blanks and nulls."""
    dice = random.Random(11)
    syllables = ["ka", "lo", "mer", "tin", "su", "bra"]
    name = lambda: " ".join("".join(dice.choices(syllables, k=dice.randint(1, 3))) for _ in range(dice.randint(1, 3)))
    lists = {"long": [(f"v{i}", f"{name()} {i}") for i in range(4990)] + [("q", name()) for _ in range(10)]}
    for n in range(8):
        lists[f"short{n}"] = [(dice.choice(["a", "b", name()]), name().title()) for _ in range(dice.randint(1, 9))]
    lists["places"] = [("US", "United States of America"), ("DE", "Germany"), ("GB", "United Kingdom (UK)"), ("y", "Yes"), ("n", "No (default)")]
    lists["odd"] = [("", ""), (None, "Null value"), ("null text", None), ("--", "--"), ("same", "Twice"), ("other", "Twice"), ("x", "Tw")]
    return lists, name, dice


@pytest.fixture(scope="module")
def case(spark):
    lists, name, dice = _lists()
    rows = [(k, i, v, t) for k, options in lists.items() for i, (v, t) in enumerate(options)]
    wanted = [(k, name()) for k in lists for _ in range(12)]
    wanted += [("long", w) for w in ("v17", "4321", "ka", "lo 77", "77 lo", "q", "mer", "nothing at all")]
    wanted += [("long", f"choose {lists['long'][i][1]} now") for i in (3, 1999, 4000)]
    wanted += [("long", " ".join(reversed(lists["long"][i][1].split()))) for i in (5, 700, 4800)]
    wanted += [("places", w) for w in ("USA", "Deutschland", "uk", "yes please", "y", "No", "default", "Un", "NO (default)")]
    wanted += [("odd", w) for w in ("null value", "value null", "twice", "Tw", "t", "--", "", None, "null text", "text")]
    wanted += [("missing", "USA"), (None, "USA")]
    offered = spark.createDataFrame([(k, [(v, t) for v, t in o]) for k, o in lists.items()], OFFERED)
    return spark.createDataFrame(rows, OPTIONS), spark.createDataFrame(wanted * 2, "list_id string, desired string"), offered, dice


def test_lists_resolve_as_arrays(spark, case):
    options, wanted, offered, _ = case
    arrays = wanted.distinct().join(offered, "list_id").withColumn("r", resolve_option(F.col("desired"), F.col("options")))
    expected = {(r.list_id, r.desired): (r.r.option, r.r.quality) for r in arrays.filter("r IS NOT NULL").select("list_id", "desired", "r").collect()}
    rows = resolve_in_lists(wanted, options).collect()
    assert {(r.list_id, r.desired): (r.option, r.quality) for r in rows} == expected
    assert len(rows) == len(expected) and {q for _, q in expected.values()} == {"exact", "substring"}
    assert ("long", "v17") in expected and ("long", "ka") not in expected and len(expected) < wanted.distinct().count()


def test_several_values_resolve_as_arrays(spark, case):
    options, wanted, offered, dice = case
    given = {}
    for r in sorted(wanted.filter("list_id IS NOT NULL").distinct().collect(), key=str):
        given.setdefault(r.list_id, []).append(r.desired)
    fields = [(f"{k}{n}", k, dice.choices(v, k=dice.randint(1, 6))) for k, v in given.items() for n in range(4)]
    fields += [("none", "places", []), ("null", "places", None), ("dup", "places", ["USA", "us", "Germany", "USA"])]
    asked = spark.createDataFrame(fields, "field string, list_id string, desired array<string>")
    arrays = asked.join(offered, "list_id").withColumn("r", resolve_each(F.col("desired"), F.col("options"))).filter("r IS NOT NULL")
    expected = {r.field: (r.r.options, r.r.quality) for r in arrays.select("field", "r").collect()}
    assert {r.field: (r.options, r.quality) for r in resolve_each_in_lists(asked, options).collect()} == expected
    assert [o.value for o in expected["dup"][0]] == ["US", "DE"]


def test_no_options_and_no_values(spark, case):
    options, wanted, _, _ = case
    assert resolve_in_lists(wanted, options.limit(0)).count() == 0
    assert resolve_in_lists(wanted.limit(0), options).count() == 0
