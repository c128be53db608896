"""Token counts, BPE and packing against the tokenizers' libraries; search against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formweave.llm import byte_bpe, impact_topk, packing, token_counts, vptree, vocabulary, word_ids
from formweave.llm.shared import kept

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", " ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "é", "Σ", "ΑΣ", "İ", "ß", "漢", "😀", "<|endoftext|>", "'s", "'S",
          "1", "²", "_", "-", "\r", "﻿", "\x00", "한", "tion", "the ", "Licensed", "!!!!", "Å", "<|startoftext|>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


@pytest.fixture(scope="module")
def own():
    ranks = vocabulary.read_ranks(MULTI)
    return {
        "count": token_counts.counter(vocabulary.read_json(BYTES)), "words": word_ids.encoder(vocabulary.read_json(WORDS)),
        "bytes": Tokenizer.from_file(BYTES), "lower": Tokenizer.from_file(WORDS), "ranks": ranks,
        "tiktoken": tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}),
    }


def test_pattern_is_the_public_one():
    assert vocabulary.BYTE_LEVEL_WORDS == public_tokenizers.PATTERN


# characters that only some of the Unicode versions at work here know are not compared
@given(TEXT | st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_texts_as_the_libraries(own, text):
    assert own["count"](text) == len(own["bytes"].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(own["words"](text), "<u4").tolist() == own["lower"].encode(text, add_special_tokens=False).ids


@given(st.binary(min_size=1, max_size=40) | TEXT.filter(bool).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_heap_merging_as_the_library(own, word):
    assert byte_bpe.heap_ids(word, own["ranks"]) == own["tiktoken"]._core_bpe.encode_single_piece(word)


SPLIT = vocabulary.read_json(WORDS)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


@pytest.mark.parametrize("pattern", [vocabulary.BYTE_LEVEL_WORDS, SPLIT, r"[\p{L}]+|\s+(?!\S)", r"\w+|\S"])
def test_words_found_as_by_regex(pattern):
    find = vocabulary.finder(pattern)
    every = " ".join(chr(c) * 2 for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for text in [every, every + "\U0001f600a", *(t or "" for t in random_texts(300, 5))]:
        same = find(text) == regex.findall(pattern, text)
        assert same


@pytest.fixture(scope="module")
def folds(own):
    return [byte_bpe.RankedMerges(own["ranks"], fold_bytes) for fold_bytes in (8, 1000)]


@given(TEXT.filter(bool) | st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_ranked_merges_as_the_library(own, folds, word):
    for fold in folds:
        assert np.frombuffer(fold.ids(word), "<u4").tolist() == own["tiktoken"]._core_bpe.encode_single_piece(word.encode())


def test_texts_are_not_folded_row_by_row(spark, capsys):
    docs = spark.createDataFrame([(1, "a rare word")], "doc_id long, text string")
    byte_bpe.decode(byte_bpe.encode_documents(docs, MULTI), MULTI).explain()
    assert "lambda" not in capsys.readouterr().out


def test_decode_ids_of_any_rows(spark):
    docs = spark.createDataFrame([(1, [72, 72]), (2, None), (3, []), (4, [300])], "doc_id long, ids array<int>").coalesce(1)
    ranks = {r: t for t, r in vocabulary.read_ranks(MULTI).items()}
    got = {r["doc_id"]: r for r in byte_bpe.decode(docs, MULTI).collect()}
    assert got[2]["decoded"] is None and got[2]["packed"] is None
    for doc, ids in ((1, [72, 72]), (3, []), (4, [300])):
        assert bytes(got[doc]["decoded"]) == b"".join(ranks[i] for i in ids)
        assert bytes(got[doc]["packed"]) == np.array(ids, "<u4").tobytes()


def test_merge_counts_of_long_words(own):
    for word in ("a" * 20_000, "ab" * 5000 + "ç" * 300):
        assert own["count"](word) == len(own["bytes"].encode(word, add_special_tokens=False).ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, None, "", "x" * 300, " " * 200, "the cat " * 3000]


def test_count_tokens(spark, own):
    texts = random_texts(150, 1)
    docs = spark.createDataFrame([(i % 140, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, BYTES).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(own["bytes"].encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("frequent", [1, 100, 1_000_000])
def test_encode_and_decode(spark, own, frequent):
    texts = random_texts(120, 2)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = byte_bpe.decode(byte_bpe.encode_documents(docs, MULTI, frequent=frequent), MULTI).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == own["tiktoken"].encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert bytes(r["packed"]) == np.array(r["ids"], "<u4").tobytes()


def test_encode_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_documents(docs, MULTI).count() == 0


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["even", "small", "equal", "halves", "none", "one"])
def test_packing_is_tight(spark, kind):
    rng = random.Random(3)
    lengths = {
        "even": [rng.randint(1, 256) for _ in range(900)], "small": [rng.randint(1, 9) for _ in range(900)], "equal": [100] * 500,
        "halves": [128] * 101 + [129] * 20, "none": [], "one": [256],
    }[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack(items, 256).collect()
    placed = {r["item"]: r for r in got}
    assert sorted(placed) == list(range(len(lengths)))
    n = check_packing([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": lengths[i]} for i, r in placed.items()], 256)
    least = {"equal": 250, "halves": 71}.get(kind, -(-sum(lengths) // 256))
    assert n <= least * 1.02 + 1


@pytest.mark.parametrize(("parts", "longer"), [(3, 0), (5, 0), (6, 0), (6, 1)])
def test_equal_parts_of_a_sequence_are_tight(spark, parts, longer):
    # with a longer piece fewer slots surely fit at first
    n, length = 6000, 4096 // parts
    of = lambda item: length + 300 * (item < longer)
    items = spark.createDataFrame([(i, of(i)) for i in range(n)], "item long, length long")
    got = packing.pack(items, 4096).collect()
    used = check_packing([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": of(r["item"])} for r in got], 4096)
    assert len(got) == n and used <= n // parts + 2


def test_partitions_meet_by_rank():
    # two pieces wait in part 0, one in part 1; part 1 has one slot over, part 2 three
    assert packing._meet([(0, 2, 0), (1, 1, 1), (2, 0, 3)]) == [(0, 1, 2, 1, 0), (1, 0, 1, 2, 0), (0, 0, 1, 2, 1)]


def test_pack_documents(spark, own):
    texts = [*random_texts(60, 4), "the cat sat " * 2000, "z " * 4095, "z " * 4096]
    docs = spark.createDataFrame([(None if i == 7 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item int")
    got = packing.pack_documents(docs, WORDS).collect()
    check_packing(got, 4096)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(texts):
        ids = np.array([*own["lower"].encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted(by_doc[None if i == 7 else i]) == want
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def embeddings(spark, n=900, dims=12, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype("f4").astype(float)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(1000, None, 1), (1100, [], 1), (1200, [None, *rows[1][1][1:]], 1), (1300, [float("nan")] * dims, 1), (1400, [float("inf")] * dims, 1),
           (1500, [0.0] * dims, 1), (1600, [1.0, 2.0], 1), (1601, [3.0, 1.0], 1), (None, rows[0][1], 1), (0, rows[0][1], 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v int")


def test_top_k_is_exact(spark):
    x, frame = embeddings(spark)
    got = {}
    for r in impact_topk.top_k(frame, shard_rows=200, block_rows=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    q = np.vstack([np.floor(1024 * x), np.zeros(x.shape[1])]).astype(int)
    ids = np.append(np.arange(len(x)), 1500)
    assert set(got) == {*range(0, 900, 100), 1500, 1600}
    assert got[1600] == {1: (1601, 1024 * 1024 * 5)}
    for query, found in got.items():
        if query != 1600:
            scores = q @ q[ids == query][0]
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:10]
            assert [found[r] for r in range(1, 11)] == [(ids[i], scores[i]) for i in order]
    assert impact_topk.top_k(frame.limit(0)).count() == 0


def test_too_large_components(spark):
    frame = spark.createDataFrame([(0, [1e9]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        impact_topk.top_k(frame).collect()


@pytest.mark.parametrize(("factor", "recall"), [(1.0, 1.0), (vptree.FACTOR, 0.9)])
def test_nearest(spark, factor, recall):
    x, frame = embeddings(spark)
    got = {}
    for r in vptree.nearest(frame, factor=factor, shard_rows=300, block_rows=4, leaf=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {*range(0, 900, 100), 1600}
    hits = 0
    for query in range(0, 900, 100):
        d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != query][:10]
        found = [got[query][r] for r in range(1, 11)]
        hits += len(set(order) & {v for v, _ in found})
        assert all(abs(d[v] - s) < 1e-12 for v, s in found)
        if factor == 1:
            assert [v for v, _ in found] == order
    assert hits >= recall * 90
    assert vptree.nearest(frame.limit(0)).count() == 0


def test_pruning_passes_over_leaves():
    x = np.random.default_rng(1).normal(size=(2000, 3))
    tree = vptree.Tree(x, 32)
    gaps = tree.gaps(x[:50])
    _, d = vptree.search(tree, np.arange(2000), x[:50], np.arange(50), 10, 1.0)
    assert (gaps <= d[:, -1:]).mean() < 0.5


def test_a_worker_keeps_what_it_made():
    class Sent:
        value = {"spec": 3}

    made = []
    for _ in range(3):
        assert kept(Sent, lambda held: made.append(held["spec"]) or len(made)) == 1
    assert made == [3]
