"""Signatures of sets: their elements, and how few pairs meet under them."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from formweave.functions.text import tokens_of, trigrams_of
from formweave.operators import retrieval as R
from formweave.operators import set_signatures as S

TEXTS = ["a", "", "notice period", "aaaa aaaa", "\U0001d49c\U0001d49db \U0001d49c\U0001d49db \U0001d49c", "ø 東京 é\u0301 x", "x  y x", "\U0001d49c"]


def test_elements_are_those_of_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    want = df.select("i", F.size(trigrams_of(F.col("t"))).alias("g"), F.size(tokens_of(F.col("t"))).alias("w")).orderBy("i").collect()
    for measure, name in ((S.trigram_sets, "g"), (S.word_sets, "w")):
        row, hashes = measure(TEXTS)
        assert np.bincount(row, minlength=len(TEXTS)).tolist() == [r[name] for r in want]
        assert len(set(zip(row.tolist(), hashes.tolist(), strict=True))) == len(row)
        # the same whatever else is in the batch
        for i, text in enumerate(TEXTS):
            assert sorted(measure([text])[1].tolist()) == sorted(hashes[row == i].tolist())


def test_few_pairs_of_texts_with_common_elements_meet(spark):
    """Lines of a few syllables share most of their windows, also the rare ones."""
    rnd = random.Random(5)
    syllables = "er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve th wh sh ing ion".split()
    lines = {" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(40)) for _ in range(600)}
    near = {line.replace(" ", " on ", 1) for line in list(lines)[:20]}
    df = spark.createDataFrame([("g", line) for line in lines | near], "grp string, text string")
    side = df.select("text", F.xxhash64("grp", "text").alias("id"), F.xxhash64("grp").alias("g"))
    met = R._candidates(side, side, 1, R.DEDUP_THRESHOLD).count()
    found = R.similar_pairs(df, df, R.DEDUP_THRESHOLD, tokens=False).filter("text <> other").count()
    assert found >= 30 and met <= 640 + 2 * found


def _jaccard(a: str, b: str) -> float:
    x, y = ({f" {s} "[i : i + 3] for i in range(len(s))} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_texts_that_meet_themselves_lose_no_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 3)  # so that frequent parts meet block by block
    rnd = random.Random(8)
    words = "notice period of the last project you led at work describe".split()
    some = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(120)]
    texts = {w for s in some for w in (s, s + "s", s.replace(" of", " off", 1), s[1:])} | {"", "a", "ab", "x" * 50, "x" * 60, "\U0001d49c b"}
    rows = [(g, s) for g in "gh" for s in sorted(texts)]
    df = spark.createDataFrame(rows, "grp string, text string")
    numbers = {r.a: (r.grp, r.text) for r in df.select("grp", "text", R.text_number(F.col("grp"), F.col("text")).alias("a")).collect()}
    assert len(numbers) == len(rows)
    for t in (0.92, 0.7):
        met = [(numbers[r.a], numbers[r.b]) for r in R.similar_numbers(df, t).collect()]
        near = {frozenset(p) for p in met}
        assert len(near) == len(met) and all(a[0] == b[0] and a != b for a, b in met)
        want = {frozenset([("g", a), ("g", b)]) for a in texts for b in texts if a < b and _jaccard(a, b) >= t}
        assert len(want) > 100 and want <= near


def test_a_text_sends_few_bytes_of_parts():
    """A part in nine bytes, and parts for one class or two, not for three on one side and one on the other."""
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(55)) for _ in range(200)]
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(range(200)), S.pa.array([7] * 200), S.pa.array(texts)], names=["a", "g", "text"])
    packs = [r for out in S.pack_rows([batch], 0.92) for r in out.to_pylist()]
    assert len({r["p"] for r in packs}) > 500
    assert sum(len(r["b"]) for r in packs) < 200 * 9 * 45
    shared = [r for out in S.shared_rows([S.pa.RecordBatch.from_pylist(packs + packs)]) for r in out.to_pylist()]
    # a text does not meet itself
    assert all(r["r"] > 1 for r in shared) and len(shared) < 50
