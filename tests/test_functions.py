"""Scalar functions on tables of cases; one small job per function."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from formweave.functions import dates as D
from formweave.functions import fields as R
from formweave.functions import text as X
from formweave.functions import urls as U
from formweave.operators.options import resolve_each, resolve_option
from formweave.rules import lexicon, telemetry


def values(spark, schema, rows, *columns):
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns)
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(out.collect())]


def test_normalize_label(spark):
    rows = [("First Name *",), ("  Email Address: (required) ",), ("LinkedIn URL",), ("Größe (optional)✱",), ("don't",), (" a b",)]
    assert values(spark, "s string", rows, X.normalize_label(F.col("s"))) == [
        "first name", "email address", "linkedin url", "größe", "don t", "a b"]


def test_similarity(spark):
    rows = [("first name", "last name"), ("same words", "same words"), ("", "x"), ("ab", "ab")]
    got = values(spark, "a string, b string", rows, X.token_jaccard(F.col("a"), F.col("b")), X.fuzzy_score(F.col("a"), F.col("b")))
    assert [round(t, 4) for t, _ in got] == [0.3333, 1.0, 0.0, 1.0]
    assert [round(f, 4) for _, f in got] == [0.4615, 1.0, 0.0, 1.0]


@pytest.mark.parametrize("a,b,same", [
    ("United States", "USA", True), ("U.S.", "United States of America", True), ("United States", "United Kingdom", False),
    ("Yes", "yes", True), ("Prefer not to say", "Decline to self-identify", True), ("South Africa", "South Africa (ZA)", True),
    ("United Kingdom", "ZA", False), ("Western Cape", "Western Cape (WC)", True), ("Ontario", "ON", True), ("No", "Norway", True),
    ("", "", False), ("don't", "dont", False),
])
def test_same_meaning(spark, a, b, same):
    assert values(spark, "a string, b string", [(a, b)], X.same_meaning(F.col("a"), F.col("b"))) == [same]


def test_places(spark):
    rows = [("South Africa",), ("za",), ("U.S.A.",), ("Deutschland",), ("Korea, South",), ("Côte d’Ivoire",), ("Narnia",), ("California",)]
    got = values(spark, "s string", rows, X.country_key(F.col("s")), X.state_key(F.col("s")))
    assert [c for c, _ in got] == ["ZA", "ZA", "US", "DE", "KR", "CI", None, None] and got[-1][1] == "US:CA"
    phones = [("+27 76 189 1101",), ("0044 20 7946 0958",), ("076 189 1101",), ("+1 (499) 555",)]
    assert values(spark, "s string", phones, X.dial_from_phone(F.col("s"))) == ["27", "44", None, "1"]


def test_dates(spark):
    rows = [("2023-04", "MM/DD/YYYY"), ("2023-04-15", "DD/MM/YYYY"), ("2023-04", "YYYY-MM-DD"), ("2023-04", "MM/YYYY"),
            ("2023-04", "yyyy/mm"), ("April 2023", "MM/DD/YYYY"), ("2023-04", "?")]
    assert values(spark, "d string, h string", rows, D.format_date(F.col("d"), F.col("h"))) == [
        "04/01/2023", "15/04/2023", "2023-04-01", "04/2023", "2023/04", "April 2023", "04/01/2023"]
    parts = [("Mar 2021",), ("Sept. 2020",), ("3 / 2021",), ("2020",), (" later ",)]
    assert values(spark, "s string", parts, D.iso_month(F.col("s"))) == ["2021-03", "2020-09", "2021-03", "2020-01", "later"]
    hours = [(0, 5_400_000), (0, 180_000), (None, 5)]
    assert values(spark, "a long, b long", hours, D.hours_since(F.col("a"), F.col("b"))) == [1.5, 0.1, None]


def test_urls(spark):
    rows = [("HTTP://A.com",), ("https://x.Y:443/p?q#f",), ("https://u:p@x:8080/a",), ("nope",), ("https://Jobs.Lever.co/a?b",)]
    got = values(spark, "u string", rows, U.canonical_url(F.col("u")), U.url_host(F.col("u")), U.detect_ats(F.col("u")))
    assert got == [("http://a.com/", "a.com", "generic"), ("https://x.y/p", "x.y", "generic"), ("https://x:8080/a", "x", "generic"),
                   ("nope", "", "generic"), ("https://jobs.lever.co/a", "jobs.lever.co", "lever")]


def test_titles(spark):
    rows = [("Job Application for Night Nurse at Lakeside", "greenhouse"), ("Music Teacher at Hill School", "generic"),
            ("Quarry - Site Manager", "lever"), ("Kiln & Clay | Glaze Specialist", "generic"), ("Tram Coordinator at Linie 9 - Careers", "generic"),
            ("", "generic"), ("A - B", "lever"), ("A - B", "generic"), ("Welcome", "generic"), ("Nurse", "generic")]
    c = U.parse_job_title(F.col("t"), F.col("a"))
    assert values(spark, "t string, a string", rows, c["company"], c["role"]) == [
        ("Lakeside", "Night Nurse"), ("Hill School", "Music Teacher"), ("Quarry", "Site Manager"), ("Kiln & Clay", "Glaze Specialist"),
        ("Linie 9", "Tram Coordinator"), (None, None), ("A", "B"), ("B", "A"), (None, None), (None, "Nurse")]


def test_templates(spark):
    rows = [("I join {Company} as {role}.", "A$1\\", "Eng"), ("I love {company}", None, "x"), ("plain", None, None), ("{role}", "{role}", "{company}")]
    assert values(spark, "t string, c string, r string", rows, U.substitute_template(F.col("t"), F.col("c"), F.col("r"))) == [
        "I join A$1\\ as Eng.", None, "plain", "{company}"]


def opts(*pairs):
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("text")) for v, t in pairs])


def test_options(spark):
    countries = opts(("it", "Italy"), ("gr", "Greece"), ("za", "South Africa"), ("kr", "South Korea"))
    rows = [("Italia",), ("Africa",), ("South",), ("Peru",), ("",)]
    r = resolve_option(F.col("d"), countries)
    assert values(spark, "d string", rows, r["option"]["value"], r["quality"]) == [
        ("it", "exact"), ("za", "substring"), (None, None), (None, None), (None, None)]
    dials = opts(("a", "Chile (+56)"), ("b", "Norway (+47)"), ("c", "Japan (+81)"))
    assert values(spark, "d string", [("+81",), ("+47",)], resolve_option(F.col("d"), dials)["option"]["value"]) == ["c", "b"]
    each = resolve_each(F.split("d", ";"), countries)
    got = values(spark, "d string", [("Greece;Italia;IT",), ("Africa;GR",), ("x",)], F.transform(each["options"], lambda o: o["value"]), each["quality"])
    assert got == [(["gr", "it"], "exact"), (["za", "gr"], "substring"), (None, None)]


def test_confidence_and_bands(spark):
    rows = [("adapter", "exact", 1.0), ("autocomplete", "not-applicable", 1.0), ("lexicon", "substring", 1.0), ("answer-fuzzy", "exact", 0.85),
            ("answer-fuzzy", "substring", 0.85)]
    score = R.confidence(F.col("s"), F.col("q"), F.col("r"))
    assert values(spark, "s string, q string, r double", rows, score, R.action_for(score)) == [
        (1.0, "fill"), (0.978, "fill"), (0.76, "fill-amber"), (0.805, "fill-amber"), (0.655, "review")]


def test_gates(spark):
    rows = [("fill", "eeo", False, False), ("fill", "legal", True, False), ("fill", "salary", False, True), ("fill", "salary", False, False),
            ("fill", "file", False, False), ("fill", "normal", False, False), ("review", "eeo", True, False)]
    g = R.gated(F.col("a"), F.col("r"), F.col("e"), F.col("s"))
    got = values(spark, "a string, r string, e boolean, s boolean", rows, g["action"], g["reason"])
    assert [a for a, _ in got] == ["review", "fill-amber", "fill-amber", "review", "fill-amber", "fill", "review"]
    assert [bool(r) for _, r in got] == [True, False, False, True, False, False, False]


def test_accept(spark):
    rows = [(".pdf,.docx", "a.PDF", "application/pdf", True), (".docx", "a.pdf", "application/pdf", False), ("application/*", "a.x", "application/pdf", True),
            ("Application/PDF", "a", "application/pdf", True), (" , ", "a", "", True)]
    assert values(spark, "a string, f string, m string, w boolean", rows, R.accept_allows(F.col("a"), F.col("f"), F.col("m"))) == [r[3] for r in rows]


def test_labels_of_names_and_urls_in_messages(spark):
    rows = [("billingCity[0]_x-y", "at chrome-extension://abc/bg.js and FILE:///u/x")]
    assert values(spark, "n string, m string", rows, X.humanize_name(F.col("n")), X.strip_urls(F.col("m")), X.truncate(F.lit("a" * 61))) == [
        ("billing City 0 x y", "at <url> and <url>", "a" * 60 + "…")]


def test_rule_tables_are_consistent():
    keys = set(lexicon.CANONICAL_KEYS)
    assert {e.key for e in lexicon.lexicon()} <= keys and set(lexicon.autocomplete_tokens().values()) <= keys
    assert not {p for ps in telemetry.event_schema().values() for p in ps} & set(telemetry.FORBIDDEN_PARAMS)
    assert (len(lexicon.lexicon()), len(keys), len(telemetry.event_schema())) == (45, 48, 26)


def test_sql_functions(spark):
    X.register_sql_functions(spark)
    row = spark.sql("SELECT normalize_label('A *') AS n, fuzzy_score('first name', 'last name') AS f").first()
    assert row.n == "a" and round(row.f, 4) == 0.4615


def test_wide_spaces_end_links_and_part_dates(spark):
    rows = [("see https://a.example/x next", "Mar 2021"), ("file:///a b", "3 / 2021")]
    got = values(spark, "s string, d string", rows, X.strip_urls(F.col("s")), D.iso_month(F.col("d")))
    assert got == [("see <url> next", "2021-03"), ("<url> b", "2021-03")]


def test_url_paths_in_normal_form(spark):
    rows = [("https://h.example/a b/../c",), ("https://h.example/a/./b/..",), ("https://h.example/é?x",), ("https://h.example/../../x/",),
            ("https://h.example/a/%2E%2e/b",), ("https://h.example//a//",), ("https://h.example/.a/..b",), ("https://h.example/a\n/b",)]
    assert values(spark, "u string", rows, U.canonical_url(F.col("u"))) == [
        "https://h.example/c", "https://h.example/a/", "https://h.example/%C3%A9", "https://h.example/x/",
        "https://h.example/b", "https://h.example//a//", "https://h.example/.a/..b", "https://h.example/a/b"]
