"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word is a row of byte pieces (as hex digits in brackets).  All tokens that
its bytes hold are looked up in a literal rank map, which is part of the plan
and cut into small buckets by a checksum of the key, so that a lookup looks
at a few entries.  `aggregate` folds the merges that make these tokens over
the pieces by ascending rank: each turns every pair it applies to, from the
left, into one piece.  That is the order of pair-wise merging, for a merged
piece only enters merges of higher rank, and a token is only ever made from
one pair of pieces, the one that its own bytes end up as.  Decoding takes
each id's piece from an array and cuts the row of pieces by documents.

Words repeat, and folding is dear, so it is done for distinct words.  One
pass counts the texts that have a word.  The `frequent` most frequent ones,
a bounded number, are folded in Spark and sent to the second pass over the
texts, which puts their ids in place.  There other words are folded in the
worker by the same merges, and the latest ones remembered.  No text and no
id is shuffled.

A fold takes time with the square of the word's length.  Words over
`fold_bytes` bytes therefore are merged by a heap over a linked list in the
second pass.

Defined cases: a null or empty text has no ids and decodes to nothing;
special strings are ordinary text; repeated rows are encoded each; an empty
table gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from functools import partial
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.shared import kept, written
from formweave.llm.vocabulary import BYTE_LEVEL_WORDS, WordCache, finder, read_ranks

FREQUENT = 500_000
FOLD_BYTES = 64
BUCKETS = 16384
#: Words that a counting task holds before it passes them on.
HELD = 500_000
#: Words that a worker remembers besides the frequent ones.
REMEMBERED = 200_000
NO_RANK = (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two pieces that merge into a token, by merging its bytes up to the last step."""
    pieces = [token[i : i + 1] for i in range(len(token))]
    while len(pieces) > 2:
        rank, at = min((ranks.get(pieces[i] + pieces[i + 1], NO_RANK), i) for i in range(len(pieces) - 1))
        if rank == NO_RANK:
            return None
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return (pieces[0], pieces[1]) if len(pieces) == 2 else None


class Literals:
    """The vocabulary as literals of a plan.

    Merges are looked up by what they make.  `f` is the pair to find and `t`
    the piece that takes its place, pieces being written as <hex digits>.
    """

    def __init__(self, ranks: dict[bytes, int]):
        maps: list[dict[str, dict]] = [{} for _ in range(BUCKETS)]
        self.longest = max(map(len, ranks))
        for piece, rank in ranks.items():
            digits = piece.hex().upper()
            pair = merged_pair(piece, ranks)
            entry = {"r": rank} | ({"f": "".join(f"<{x.hex().upper()}>" for x in pair), "t": f"<{digits}>"} if pair else {})
            maps[zlib.crc32(digits.encode()) % BUCKETS][digits] = entry
        # all fold to constants before the query runs
        self.maps = F.from_json(F.lit(json.dumps(maps)), "array<map<string,struct<r:int,f:string,t:string>>>")

    @staticmethod
    def entry(maps: Column, digits: Column) -> Column:
        return F.get(maps, (F.crc32(digits.cast("binary")) % BUCKETS).cast("int"))[digits]

    def encode(self, word: Column) -> Column:
        """array<int>: ids of a word in binary."""
        n = F.octet_length(word)

        def stretches(maps: Column, d: Column) -> Column:
            # all tokens that the word's bytes hold
            return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
                F.sequence(F.lit(2), F.least(n - i + 1, F.lit(self.longest))), lambda k: self.entry(maps, F.substring(d, i * 2 - 1, k * 2))
            )))

        def fold(maps: Column, d: Column) -> Column:
            merges = F.sort_array(F.filter(stretches(maps, d), lambda m: m["f"].isNotNull()))
            pieces = F.aggregate(merges, F.regexp_replace(d, "(..)", "<$1>"), lambda state, m: F.replace(state, m["f"], m["t"]))
            # <61><6263> to its pieces
            return F.transform(F.split(F.btrim(pieces, F.lit("<>")), "><"), lambda p: self.entry(maps, p)["r"])

        def ids(maps: Column, d: Column) -> Column:
            return _let(self.entry(maps, d)["r"], lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(maps, d)))

        # the literal stands in the plan once
        found = _let(self.maps, lambda maps: _let(F.hex(word), lambda d: ids(maps, d)))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(found)


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word in time n log n: a heap of pairs over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, 1, 1) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        # stale if one of the two was merged meanwhile
        if len(piece[i]) != a or j >= n or len(piece[j]) != b:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (rank := ranks.get(piece[x] + piece[y])) is not None:
                heappush(heap, (rank, x, len(piece[x]), len(piece[y])))
    return [ranks[p] for p in piece if p]


class RankedMerges:
    """The fold in a worker: ids of a word as little-endian unsigned 32-bit integers.

    A piece is the character with its rank's number, so that a merge is one
    `replace` and the ids are the characters' code points.
    """

    def __init__(self, ranks: dict[bytes, int], fold_bytes: int):
        self.ranks, self.fold_bytes, self.longest = ranks, fold_bytes, max(map(len, ranks))
        self.letters = [chr(ranks[bytes([b])]) for b in range(256)]
        self.merges = {
            piece: (rank, "".join(chr(ranks[x]) for x in pair), chr(rank))
            for piece, rank in ranks.items() if (pair := merged_pair(piece, ranks))
        }

    def ids(self, word: str) -> bytes:
        raw = word.encode()
        n = len(raw)
        if raw in self.ranks:
            return pack("<I", self.ranks[raw])
        if n > self.fold_bytes:
            return np.array(heap_ids(raw, self.ranks), "<u4").tobytes()
        find = self.merges.get
        merges = [m for i in range(n - 1) for j in range(i + 2, min(n, i + self.longest) + 1) if (m := find(raw[i:j]))]
        merges.sort()
        pieces = "".join([self.letters[b] for b in raw])
        for _, pair, merged in merges:
            pieces = pieces.replace(pair, merged)
        return pieces.encode("utf-32-le", "surrogatepass")


def _word_counts(batches, pattern: str):
    find, counts = finder(pattern), Counter()

    def passed_on():
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            counts.update(set(find(text or "")))
            if len(counts) > HELD:
                yield from passed_on()
                counts.clear()
    yield from passed_on()


class KnownWords(dict):
    """Ids of frequent words by word; others are folded when they are asked for, and the latest ones remembered.

    table: word, ids as an Arrow stream; so it lies on the driver and goes on its way.
    """

    def __init__(self, table: bytes, ranks: dict[bytes, int], fold_bytes: int):
        found = pa.ipc.open_stream(table).read_all()
        ids = found["ids"].combine_chunks()
        cuts, flat = np.asarray(ids.offsets), ids.values.to_numpy().astype("<u4")
        super().__init__((w, flat[a:b].tobytes()) for w, a, b in zip(found["word"].to_pylist(), cuts[:-1], cuts[1:], strict=True))
        self.rare = WordCache(RankedMerges(ranks, fold_bytes).ids, REMEMBERED)

    def __missing__(self, word):
        return self.rare[word]


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _encoded(batches, pattern: str, sent):
    """docs with ids."""
    known = kept(sent, lambda held: KnownWords(held.pop("table"), held["ranks"], held["fold_bytes"]))
    find, look = finder(pattern), known.__getitem__
    for batch in batches:
        found = [b"".join(map(look, find(text or ""))) for text in batch["text"].to_pylist()]
        cuts = np.cumsum([0] + [len(f) // 4 for f in found])
        values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)], names=[*batch.schema.names, "ids"]
        )


def encode_documents(docs: DataFrame, path: str, pattern: str = BYTE_LEVEL_WORDS, frequent: int = FREQUENT, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """docs with ids (array<int>) by the ranks in the file at `path`, each match of `pattern` separately."""
    ranks = read_ranks(path)
    literals = Literals(ranks)
    docs = docs.drop("ids")
    counts = docs.select("text").mapInArrow(partial(_word_counts, pattern=pattern), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # a bounded number of rows
    top = written(counts.filter(F.octet_length("word") <= fold_bytes).orderBy(F.desc("n"), "word").limit(frequent).select("word"), "frequent-words")
    spread = top.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    found = written(spread.select("word", literals.encode(F.col("word").cast("binary")).alias("ids")), "frequent-ids").toArrow()
    # a broadcast variable, for a worker keeps it from task to task
    known = docs.sparkSession.sparkContext.broadcast({"table": _stream(found), "ranks": ranks, "fold_bytes": fold_bytes})
    encode = partial(_encoded, pattern=pattern, sent=known)
    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _cut(flat: pa.Buffer, cuts: np.ndarray) -> pa.Array:
    """binary values, one after the other in flat."""
    if len(cuts) and cuts[-1] >= 1 << 31:
        raise ValueError("a batch of rows holds 2 GB of ids or more: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), flat])


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ids of all rows and where each row's begin (one more entry: the end)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.cumsum(np.append(0, sizes), dtype=np.int64)


def decode(docs: DataFrame, path: str) -> DataFrame:
    """docs with decoded (binary) and packed (ids as little-endian unsigned 32-bit integers) of their ids."""
    ranks = read_ranks(path)
    names = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece
    sent = docs.sparkSession.sparkContext.broadcast({"pieces": names})

    def decoded(ids: pa.Array) -> pa.Array:
        flat, cuts = _flat(ids)
        pieces = kept(sent, lambda held: pa.array(held["pieces"], pa.large_binary())).take(flat)
        _, where, data = pieces.buffers()
        ends = np.frombuffer(where, np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        return _cut(data, ends[cuts])

    def packed(ids: pa.Array) -> pa.Array:
        flat, cuts = _flat(ids)
        return _cut(pa.py_buffer(flat.to_numpy(zero_copy_only=False).astype("<i4")), 4 * cuts)

    # null ids of a row are null in the result, as they came
    of_ids = lambda make: F.when(F.col("ids").isNotNull(), F.arrow_udf(make, "binary")(F.col("ids")))
    return docs.withColumns({"decoded": of_ids(decoded), "packed": of_ids(packed)})
