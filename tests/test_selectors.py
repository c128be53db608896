"""Selectors of golden labels in many spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from formweave.functions.selectors import is_simple, selector_tests
from formweave.operators import evaluate as E
from formweave.operators import extract as X

PAGE = """<form><label>A <input id="a.b" name="x[1]" class="big  wide"></label><input type=radio name=r value="1">
<input type=radio name=r value=2 checked><select name=s lang="en-GB"><option>q</select><textarea id=t></textarea>
<input id="9z" name="x[2]" disabled></form>"""

# selector -> number of the field it names
NAMED = {
    "#t": 3, "textarea": 3, "TEXTAREA#t": 3, " select ": 2, "*": None, "#nothing": None, r"#a\.b": 0, "[id='a.b']": 0, '[ id = "a.b" ]': 0,
    "input.wide": 0, ".big.wide": 0, ".bi": None, "input[name='x[1]']": 0, '[name="x[2]"][disabled]': 4, "[disabled]": 4, "[DISABLED]#t": None,
    "input[name=r]": 1, "input[name=r][value='2']": 1, "[checked]": 1, "[lang|=en]": 2, "[lang^=en]": 2, "[lang$=GB]": 2, "[lang*=n-]": 2,
    "[lang*='']": None, "[class~=big]": 0, "[name=s][lang=en]": None, "input[type=radio]#t": None, r"#\39 z": 4, "form textarea": None,
    "input[name=r]:checked": None, "[lang=en i]": None, "": None, "a, b": None, "input": 0,
}


def test_selectors_name_the_first_field_that_passes(spark):
    pages = spark.createDataFrame([("p", "https://x.example/1", PAGE)], "page_id string, url string, html string")
    signals = X.form_signals(X.page_nodes(pages))
    labels = [(s, f"k{i}") for i, s in enumerate(NAMED)]
    golden = spark.createDataFrame(
        [("p", "https://x.example/1", labels, ["#t", "[name=s]"])],
        "page_id string, url string, fields array<struct<selector:string,canonical:string>>, expect_no_fill array<string>",
    )
    decisions = signals.select("page_id", "ref", F.lit("k0").alias("canonical"), F.lit("v").alias("value"), F.lit("fill").alias("action"))
    rows = E.judge(golden, signals, decisions).filter("is_label").collect()
    assert {r.selector for r in rows if r.detected} == {s for s, n in NAMED.items() if n is not None}
    owners = E._selector_owners(E.labelled_fields(golden), signals).collect()
    assert {r.selector: r.ref for r in owners if r.selector in NAMED} == {s: f"top:f{n}" for s, n in NAMED.items() if n is not None}
    found = {r.selector: r.mistake for r in E.mistakes(E.judge(golden, signals, decisions)).collect()}
    assert found["textarea"] == 'WRONG textarea: mapped to k0 (wanted k1), value="v"'
    assert found["[name=s]"] == 'FORBIDDEN FILL [name=s]: k0 = "v"' and found["#nothing"].startswith("MISSED #nothing (k")


def test_what_is_simple(spark):
    given = ["a#b.c[d]", "a b", "a>b", "a,b", "a:hover", "[a=b c]", "[a='b c']", "[a='b", None, " ", "[a=]", "*[x]"]
    rows = spark.createDataFrame([(s,) for s in given], "s string").select("s", is_simple(F.col("s")).alias("ok"), selector_tests(F.col("s")).alias("t"))
    got = {r.s: r for r in rows.collect()}
    assert [s for s in given if got[s].ok] == ["a#b.c[d]", "[a='b c']", "*[x]"]
    assert [tuple(t) for t in got["a#b.c[d]"].t] == [("", "=", "a"), ("id", "=", "b"), ("class", "~=", "c"), ("d", "", "")]
    assert [tuple(t) for t in got["[a='b c']"].t] == [("a", "=", "b c")] and [tuple(t) for t in got["*[x]"].t] == [("x", "", "")]
