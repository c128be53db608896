"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import helpers as H
import pytest

from formweave.llm import packing, plans, toxicity

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    in_order = lambda rows: sorted(rows, key=str)
    assert in_order(tuple(r[c] for c in columns) for r in got.collect()) == in_order(tuple(r[i] for i in order) for r in want.fetchall())


def test_near_dedup_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in plans.op7_minhash(spark, SF).collect()}
    assert got == H.components(docs, 3, 85)


def test_suffix_query(spark):
    import hashlib

    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in plans.op8_suffix_array(spark, SF).collect()}
    want = {d: (n, s, hashlib.sha256(b).hexdigest()) for d, (n, s, b) in H.cut_repeats(docs, 100).items()}
    assert got == want


def stage_inputs(spark, folder):
    """Documents with odd cases, extra columns with clashing names, and labels, as a table folder."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubdgkmnprst") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = prose(60), prose(8)
    rows, labels = [], []
    for d in range(240):
        parts = [prose(rng.randint(20, 120))]
        if d % 5 == 0:
            parts.append(shared)
        if d % 7 == 0:
            parts.append(f"\n{line}")
        if d % 6 == 0:
            parts.insert(0, "grumblor zugzug")
        rows.append((d, " ".join(parts)))
        labels.append((d, 1, int(d % 6 == 0)))
    rows += [(300 + i, rows[1][1]) for i in range(30)] + [(400, None), (401, ""), (None, rows[2][1]), (1, rows[1][1]), (402, prose(30_000))]
    cells = [(d, t, "en", None, None if t is None else len(t), "k", 1, 2.0) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int, score double"
    spark.createDataFrame(cells, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    stage_inputs(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if name == "packing":
            break
        assert docs.columns == columns, name
        was, now = texts_of(before.filter("doc_id IS NOT NULL")), texts_of(docs.filter("doc_id IS NOT NULL"))
        if name == "toxicity":
            bad = {d for d, t in was.items() if "zugzug" in (t or "")}
            assert bad and set(now) == set(was) - bad
            assert docs.filter("doc_id IS NULL").count() == 1
        elif name == "line_dedup":
            assert {d: t or "" for d, t in now.items()} == {d: t for d, (_, _, t) in H.dedup_lines(was).items()}
        elif name == "near_dedup":
            assert set(now) == {c for _, c in H.components(was, 5, 80).values()}
        elif name == "suffix_dedup":
            assert {d: t or "" for d, t in now.items()} == {d: b.decode("utf-8", "ignore") for d, (_, _, b) in H.cut_repeats(was, 100).items()}
        assert docs.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
        assert {(r["kept"], r["n_lines"], r["score"]) for r in docs.collect()} == {("k", 1, 2.0)}
    pieces = {(r["doc_id"], r["piece"]) for r in docs.collect()}
    assert {d for d, _ in pieces} == {r["doc_id"] for r in before.collect()}
    assert sum(r["length"] for r in docs.collect()) <= packing.CAPACITY * docs.select("sequence_id").distinct().count()


def test_pipeline_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_over_given_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_predictions_are_flags(spark):
    rows = plans.op9_toxicity(spark, SF).collect()
    assert {r["predicted"] for r in rows} <= {0, 1} and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= toxicity.THRESHOLD) for r in rows)
