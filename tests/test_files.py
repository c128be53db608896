"""Sources, sinks, gates and bundles."""

from __future__ import annotations

import json

from people import answer, answers, document, documents, from_records, person, profiles
from pyspark.sql import functions as F

from formweave import schemas
from formweave.operators import tracker as K
from formweave.operators.profiles import ready
from formweave.sources import files

APPS = """cand string, id string, url string, domain string, ats string, title string, first_seen_us long, last_filled_us long,
times_filled long, filled long, status string, reminder_us long, jd_snippet string"""


def apps(spark):
    base = {"cand": "c", "url": "https://x.example/", "domain": "x.example", "ats": "lever", "times_filled": 1, "filled": 3, "status": "saved"}
    return from_records(spark, [
        {**base, "id": "1", "title": 'A "great", role', "first_seen_us": 1_000_000},
        {**base, "id": "2", "title": "Newer", "first_seen_us": 2_500_000, "last_filled_us": 3_000_000, "jd_snippet": "Needs RUST"},
    ], APPS)


def test_pages_and_golden_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "page.html").write_text(f"<p>{name}\n</p>")
        (tmp_path / name / "golden.json").write_text(json.dumps(
            {"url": "https://x", "fields": [{"selector": "#a", "canonical": "basics.email", "kind": "email"}], "expectNoFill": ["#b"]}, indent=1))
    assert {r.page_id: r.html for r in files.read_pages(spark, str(tmp_path)).collect()} == {n: f"<p>{n}\n</p>" for n in ("one", "two")}
    golden = files.read_golden(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.page_id, r.fields[0].canonical, r.fields[0].required, r.expect_no_fill) for r in golden] == [
        ("one", "basics.email", None, ["#b"]), ("two", "basics.email", None, ["#b"])]


def test_cv_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\nline")
    (tmp_path / "b.pdf").write_text("%PDF")
    got = {r.file_name: (r.mime, r.text) for r in files.read_cv_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text/plain", "line\nline"), "b.pdf": ("application/pdf", "%PDF")}


def test_history_csv_and_json(spark, tmp_path):
    files.write_history_csv(apps(spark), str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0] == K.CSV_HEADER
    assert lines[1:] == [
        '"Newer","x.example","https://x.example/","lever","saved","1970-01-01T00:00:02.500Z","1970-01-01T00:00:03.000Z","1","3",""',
        '"A ""great"", role","x.example","https://x.example/","lever","saved","1970-01-01T00:00:01.000Z","","1","3",""']
    files.write_history_json(K.search(apps(spark), "rust"), str(tmp_path / "json"))
    assert [r.title for r in spark.read.json(str(tmp_path / "json")).collect()] == ["Newer"]


def test_gate_rejects_by_default(spark):
    rows = ['{"id":"1","role":"resume","size":3}', '{"id":"2","role":"photo"}', '{"role":"resume"}', "nonsense", '{"id":"3","role":"coverLetter"}']
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    good, bad = files.validated(lines, "id string, role string, size long", ["id", "role"], {"role": schemas.DOCUMENT_ROLES}, {"size": 0})
    assert sorted(tuple(r) for r in good.collect()) == [("1", "resume", 3), ("3", "coverLetter", 0)]
    assert {r.value for r in bad.collect()} == set(rows[1:4])


def test_bundle_round_trip(spark):
    p = profiles(spark, person("c", {"salary": "1"}), person("d"))
    a = answers(spark, answer("c", "a1", "Q?", "x", aliases=["y"]), answer("d", "a1", "R?", "z"))
    d = documents(spark, document("c", "d1", "resume", "r.pdf"))
    s = spark.createDataFrame([("c", False, False, "DD/MM/YYYY", True)], schemas.SETTINGS)
    bundle = files.export_bundle(p, a, d, s, 5)
    p2, a2, d2, rejected = files.import_bundle(bundle)
    for before, after in ((p, p2), (a, a2), (d, d2)):
        assert sorted(map(str, before.select(sorted(before.columns)).collect())) == sorted(map(str, after.select(sorted(before.columns)).collect()))
    assert rejected.count() == 0
    other = bundle.withColumn("value", F.when(F.col("section") == "header", '{"format":"x","version":1}').otherwise(F.col("value")))
    assert files.import_bundle(other)[0].count() == 0
    merged = files.upsert_by_id(a, answers(spark, answer("c", "a1", "Q?", "new")))
    assert sorted((r.cand, r.answer) for r in merged.collect()) == [("c", "new"), ("d", "z")]


def test_diagnostics_newest_first(spark):
    log = spark.createDataFrame([("c", "e1", 1), ("c", "e2", 2)], "cand string, id string, at_us long")
    report = json.loads(files.diagnostics(log, "2024-01-01T00:00:00.000Z").first().report)
    assert [e["id"] for e in report["entries"]] == ["e2", "e1"] and report["version"] == 1


def test_readiness(spark):
    nobody = person("n", basics={"firstName": "", "lastName": "x", "email": "", "phone": "", "pronouns": ""})
    off = spark.createDataFrame([("c", False), ("d", True)], "cand string, auto_detect boolean")
    got = ready(profiles(spark, person("c"), person("d"), nobody), off).collect()
    assert [r.cand for r in got] == ["d"]
