"""Line dedup, near-dedup, suffix dedup, archive and toxicity against brute force and in odd cases."""

from __future__ import annotations

import random
import tracemalloc

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from formweave.llm import line_dedup, near_dedup, plans, repeats, shared, toxicity, warc

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("aeioubdgkmnprst") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, extra=()):
    """Rows of {doc: text}; clashing names of other columns where asked for."""
    cells = [(d, t, *[7] * len(extra)) for d, t in texts.items()]
    return spark.createDataFrame(cells, "doc_id long, text string" + "".join(f", {c} int" for c in extra))


def odd(texts):
    """Null, empty, blank and short texts besides."""
    top = max(texts, default=0) + 1
    return texts | {top: None, top + 1: "", top + 2: " \n\t ", top + 3: "one", top + 4: "é" * 30}


def test_lines_match_brute_force(spark):
    lines = [prose(5) for _ in range(12)] + ["short", "", "  Mixed Case LINE of some length \t", "mixed case line of some length"]
    texts = odd({d: "\n".join(RNG.choice(lines) for _ in range(RNG.randint(1, 9))) for d in range(40)})
    texts[60] = "\n".join(lines[0] for _ in range(2000))
    got = line_dedup.dedup_lines(documents(spark, texts, ("n_lines", "pos", "keeper")), fanout=2, batches=5)
    want = H.dedup_lines(texts)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()} == want
    assert {"pos", "keeper"} <= set(got.columns)


def test_lines_of_repeated_rows_and_missing_ids(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line), (None, line), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["n_dropped"] == 0 for r in got.collect()) and got.count() == 5
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, (3, line)], "doc_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, ""), (2, ""), (3, line), (None, line), (None, None)}


@pytest.mark.parametrize("operator", [line_dedup.dedup_lines, near_dedup.near_dedup, repeats.cut_repeats])
def test_empty_tables(spark, operator):
    assert operator(documents(spark, {})).count() == 0


def test_compaction_keeps_one_run_a_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for doc in range(7, -1, -1):
        runs.add(spark.createDataFrame([(1, 1, doc), (2, doc, doc)], "__h1 long, __h2 long, __doc long"))
    assert [len(level) for level in runs.levels] == [0, 0, 0, 1]
    found = {(r["__h1"], r["__h2"]): (r["n_docs"], r["keeper"]) for r in runs.runs().collect()}
    assert found[1, 1] == (8, 7) and found[2, 3] == (1, 3)


def edited(text, n, rng=RNG):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize(("size", "similar"), [(3, 85), (5, 80)])
def test_near_components_match_brute_force(spark, size, similar):
    texts, rng = {}, random.Random(size)
    for _ in range(12):
        base = prose(rng.randint(30, 300), rng)
        for _ in range(rng.randint(1, 9)):
            texts[len(texts)] = edited(base, rng.randint(0, 8), rng)
    for i in range(8):
        texts[len(texts)] = texts[i].upper()
    texts = odd(texts)
    texts[200] = prose(20_000)
    texts[201] = edited(texts[200], 3)
    got = near_dedup.near_dedup(documents(spark, texts, ("component", "node", "kept")), shingle=size, similar=similar)
    want = H.components(texts, size, similar)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {d: " ".join(words[d * 4 : d * 4 + 200]) for d in range(40)}
    got = near_dedup.near_dedup(documents(spark, texts))
    assert {r["component_id"] for r in got.collect()} == {c for _, c in H.components(texts, 5, 80).values()}


@pytest.mark.parametrize(("similar", "halves"), [(80, 25), (85, 17), (100, 1)])
def test_halves_follow_the_limit(similar, halves):
    miss = lambda n: 1 - (1 - (1 - (similar / 100) ** 5) ** n) ** 2
    assert near_dedup.enough_halves(similar) == halves
    assert miss(halves) <= 1e-4 and (halves == 1 or miss(halves - 1) > 1e-4)


def test_pairs_at_the_limit_are_found(spark):
    # 13 words each, moved by one: 8 of 10 shingles in common
    texts = {2 * p + i: " ".join(f"w{p}x{k}" for k in range(i, i + 13)) for p in range(4000) for i in range(2)}
    got = near_dedup.near_components(documents(spark, texts))
    assert got.filter("component = doc AND doc % 2 = 1").count() <= 2


def test_near_dedup_of_repeated_rows_and_missing_ids(spark):
    text = prose(50)
    rows = [(5, text), (5, text), (5, prose(40)), (9, text), (None, text), (None, text)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert {r["component_id"] for r in got if r["doc_id"]} == {5}
    assert all(r["kept"] for r in got if r["doc_id"] is None)


def test_sketch_passes_similar_sets():
    rng = np.random.default_rng(1)
    for n in (20, 200, 5000):
        for _ in range(20):
            common = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            side = lambda: np.unique(np.append(common, rng.integers(0, 1 << 63, n * 8 // 100, np.uint64) * np.uint64(2)))
            a, b = (np.frombuffer(near_dedup._sketch(s), np.uint8) for s in (side(), side()))
            assert near_dedup._close(a, b[None], 85).all()


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    passages = [prose(40, rng)[:220] for _ in range(5)]
    texts = {}
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng.randint(1, 30), rng) for _ in range(rng.randint(1, 6))]
        texts[d] = " ".join(parts)
    texts |= {70: texts[3], 71: texts[3], 72: "ab" * 200, 73: "é" * 150, 74: passages[0][:100], 75: passages[0][:99], 76: prose(3000, rng)}
    texts[77] = texts[76]
    texts = odd(texts)
    want = H.cut_repeats(texts, 100)
    docs = documents(spark, texts, ("start", "run", "kept"))
    for options in ({}, {"hot_runs": 2}, {"block_bytes": 300}):
        got = repeats.cut_repeats(docs, **options)
        assert {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"] or b"")) for r in got.collect()} == want, options
    text = repeats.cut_repeats(docs, as_text=True)
    assert {r["doc_id"]: r["kept"] or "" for r in text.collect()} == {d: b.decode("utf-8", "ignore") for d, (_, _, b) in want.items()}


def test_repeated_rows_do_not_erase_themselves(spark):
    text = prose(60)
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(text))]


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_common_prefixes(letters):
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice([3, 5, 9])
        runs = list({"".join(rng.choice(letters) for _ in range(rng.randint(length, length + 10))).encode() for _ in range(6)})
        text, sizes = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8), np.array([len(r) for r in runs])
        ends = np.cumsum(sizes + 1) - 1
        order = repeats.suffix_order(text, ends, length)
        suffix = lambda p: bytes(text[p : ends[np.searchsorted(ends, p)]])  # noqa: E731, B023
        want = [i > 0 and len(suffix(p)) >= length and suffix(order[i - 1])[:length] == suffix(p)[:length] for i, p in enumerate(order)]
        assert list(repeats.common_prefixes(text, ends, order, length)) == want


def test_archive_round_trip(spark):
    big, small = b"x" * 1500, b"y" * 999
    cells = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, small), (4, "http://d/", small), (5, "u", None), (6, "u", b""), (7, "é", big)]
    records = spark.createDataFrame([(i, u, None if p is None else bytearray(p)) for i, u, p in cells], "record_id long, url string, payload binary")
    archive = warc.write_archive(records.unionByName(records.filter("record_id = 1")).unionByName(records.limit(1).selectExpr("cast(null as long) record_id", "url", "payload")))
    assert archive.payloads().count() == 3
    index = {r["record_id"]: r for r in warc.read_index(archive).collect()}
    assert {i: (r["record_type"], r["refers_to"], r["n_bytes"]) for i, r in index.items()} == {
        1: ("revisit", 7, 1500), 2: ("revisit", 7, 1500), 3: ("response", None, 999), 4: ("response", None, 999),
        5: ("response", None, 0), 6: ("response", None, 0), 7: ("response", None, 1500),
    }
    assert all(index[i]["sha1"] == H.sha1(p or b"") for i, _, p in cells)
    whole = {r["record_id"]: (bytes(r["record"]), bytes(r["payload"])) for r in warc.read_records(archive).collect()}
    for i, _, payload in cells:
        record, got = whole[i]
        header, body = record.split(b"\r\n\r\n", 1)
        assert got == (payload or b"") and header.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert body == (b"" if index[i]["record_type"] == "revisit" else got) + b"\r\n\r\n"
    assert b"WARC-Target-URI: http://b/%0D%0AX: y\r\n" in whole[2][0] + b"\r\n"


def test_damaged_payload_is_an_error(spark):
    records = spark.createDataFrame([(1, "u", bytearray(b"abc"))], "record_id long, url string, payload binary")
    archive = warc.write_archive(records)
    archive.payloads().selectExpr("address", "n_bytes", "cast('abd' as binary) payload").write.parquet(f"{archive.folder}/other")
    damaged = warc.Archive(spark, archive.folder)
    damaged.payloads = lambda: spark.read.parquet(f"{archive.folder}/other")
    with pytest.raises(SparkRuntimeException, match="does not match"):
        warc.read_index(damaged).collect()


def test_query_reads_the_records(spark, monkeypatch):
    whole = warc.read_records
    cut = lambda archive: whole(archive).withColumn("record", F.expr("substring(record, 1, octet_length(record) - 5)"))
    monkeypatch.setattr(warc, "read_records", cut)
    with pytest.raises(SparkRuntimeException, match="record does not match"):
        plans.op1_warc(spark, "/root/testdata/sf0.001").collect()


def test_empty_archive(spark):
    records = spark.createDataFrame([], "record_id long, url string, payload binary")
    assert warc.read_index(warc.write_archive(records)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    texts, marks = {}, []
    for d in range(600):
        toxic = d % 3 == 0
        words = prose(rng.randint(5, 60), rng).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Grumblor,", "zugzug", "(fnord)"]))
        texts[d] = " ".join(words)
        marks.append((d, int(toxic)))
    texts |= {600: None, 601: "", 602: "zugzug " * 5000}
    docs = documents(spark, texts, ("toxic", "score"))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train_on_rest(docs, labels)
    got = toxicity.score(docs, model).withColumn("out", toxicity.held_out())
    rows = {r["doc_id"]: r for r in got.collect()}
    tested = [rows[d] for d, _ in marks if rows[d]["out"]]
    assert len(tested) > 100
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 3 == 0) for r in tested)
    assert wrong <= 2
    assert rows[600]["score"] == rows[601]["score"] < 0.5 < rows[602]["score"]


@pytest.mark.parametrize(("epochs", "l1", "learnt"), [(4, 4.0, set()), (8, 0.5, {1, 2})])
def test_features_of_one_document_go_only_where_l1_zeroes_them(epochs, l1, learnt):
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1, 0]), pa.array([[1], [2]], pa.list_(pa.int64()))], names=["toxic", "features"]
    )
    (out,) = toxicity._fit([rows], epochs, 0.1, 1.0, l1, 0.0)
    assert {k for k, i in zip(out["key"].to_pylist(), out["intercept"].to_pylist(), strict=True) if not i} == learnt


@pytest.mark.parametrize(("marks", "low", "high"), [([], 0, 0.01), ([(1, 1)], 0.99, 1), ([(1, 0), (1, 0)], 0, 0.01)])
def test_toxicity_without_two_classes(spark, marks, low, high):
    docs = documents(spark, {1: "a b", 2: None})
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert all(low <= r["score"] <= high for r in toxicity.score(docs, model).collect())
    assert toxicity.score(documents(spark, {}), model).count() == 0


def test_learning_drops_what_it_needed_to_sort_out_features():
    dice = np.random.default_rng(3)

    def batches():
        for _ in range(6):
            lists = [dice.integers(0, 100_000, 1000) for _ in range(1000)]
            yield pa.RecordBatch.from_arrays([pa.array([0, 1] * 500), pa.array(lists, pa.list_(pa.int64()))], names=["toxic", "features"])

    tracemalloc.start()
    try:
        assert len(list(toxicity._fit(batches(), 1, 1.0, 1.0, 4.0, 0.1))) == 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 48 MB of features and two marks of 64 MB; with these kept all through 290 MB
    assert peak < 230e6


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    make = shared.lean(lambda batches: (2 * b for b in batches))
    assert list(make(iter([1, 2]))) == [2, 4] and given == [1]
    # and when its reader wants no more
    some = make(iter([1, 2]))
    assert next(some) == 2
    some.close()
    assert given == [1, 1]
