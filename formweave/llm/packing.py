"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents become pieces of at most `capacity` tokens.  A piece larger than
half a sequence opens its own.  The rest go down by size classes (each half
of the one before), and in a class round by round:

* every open gap offers slots: as many as the longest pieces that wait surely fit;
* pieces and slots are range-sorted together by size, and each partition is
  swept once: a slot takes the largest piece before it that no smaller slot
  has taken, so each piece gets its successor among the slots;
* what a partition leaves over (pieces without a later slot, slots without
  an earlier piece) is matched across partitions: the counts, one row per
  partition, settle which ranks belong together, and a join on them does it;
* gaps are lowered by what they took, and the next round begins.

When gaps take next to nothing any more, as many new sequences are opened as
the tokens still waiting need, none to spare, and if that isn't enough, once
more, now with a slot for every piece.  Ties in size go by position in the
table, so equal documents are spread over partitions like any others.  A
round moves some 30 bytes a piece, and the number of rounds depends on the
size classes, not on the number of documents.

Defined cases: a null or empty text is the end token alone; repeated rows
are packed each; a null doc_id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import kept, lean, new_folder, written
from formweave.llm.vocabulary import read_json
from formweave.llm.word_ids import encoder

CAPACITY = 4096
END_ID = 1
#: Pieces up to capacity / 2^CLASSES are one class.
CLASSES = 6
#: Rounds go on while they place this share of the waiting pieces.
WORTH = 0.03

PIECES = "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SWEPT = "item bigint, length bigint, seq bigint, part int, rank bigint, is_slot boolean"


def _pieces(batches, sent, capacity: int, end_id: int):
    encode = kept(sent, lambda held: encoder(held["spec"]))
    end = np.array([end_id], "<u4").tobytes()
    item = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids = encode(text or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((item, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                item += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """item (a number for each piece), doc_id, piece, start, length, ids_crc32; by the tokenizer in the json file at `path`."""
    # a broadcast variable, for a worker keeps it, with the words it met, from task to task
    sent = docs.sparkSession.sparkContext.broadcast({"spec": read_json(path)})
    make = partial(_pieces, sent=sent, capacity=capacity, end_id=end_id)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(make), PIECES)


def _sweep(batches):
    part = TaskContext.get().partitionId()
    waiting, matched, slots = [], [], []
    for batch in batches:
        for size, is_slot, name in zip(*(batch[c].to_pylist() for c in ("size", "is_slot", "id")), strict=True):
            if not is_slot:
                waiting.append((name, size))
            elif waiting:
                matched.append((*waiting.pop(), name))
            else:
                slots.append(name)
    rows = [(i, n, s, None, None, None) for i, n, s in matched]
    rows += [(i, n, None, part, r, False) for r, (i, n) in enumerate(waiting)]
    rows += [(None, None, s, part, r, True) for r, s in enumerate(slots)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    for at in range(0, len(rows), 50_000):
        columns = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SWEPT.split(", ")])


def _meet(left_over) -> list[tuple[int, int, int, int, int]]:
    """(part, low, high, slot_part, slot_low): pieces with ranks low <= r < high of part take slots from slot_low on, the highest rank first.

    left_over: (part, pieces, slots) by ascending part.
    """
    stack, out = [], []
    for part, n_pieces, n_slots in left_over:
        done = 0
        while done < n_slots and stack:
            owner, high = stack.pop()
            n = min(high, n_slots - done)
            out.append((owner, high - n, high, part, done))
            done += n
            if high > n:
                stack.append((owner, high - n))
        if n_pieces:
            stack.append((part, n_pieces))
    return out


class Packing:
    """The state of the rounds, as tables in one shared folder."""

    def __init__(self, items: DataFrame, capacity: int):
        self.spark, self.capacity = items.sparkSession, capacity
        self.folder, self.made, self.opened = new_folder(self.spark, "packing"), 0, 0
        large = items.filter(F.col("length") * 2 > capacity)
        self.placed = [large.select("item", "length", F.col("item").alias("seq"))]
        self.gaps = large.select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap")).filter("gap > 0")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return written(df, f"{name}{self.made}", self.folder)

    def open(self, n: int) -> None:
        """n new, empty sequences; their numbers are below zero."""
        fresh = self.spark.range(self.opened, self.opened + n).select((-F.col("id") - 1).alias("seq"), F.lit(self.capacity).cast("long").alias("gap"))
        self.opened += n
        self.gaps = self.gaps.unionByName(fresh)

    def round(self, waiting: DataFrame, least: int, most: int) -> tuple[DataFrame, int, int]:
        """Match waiting pieces (item, length) of lengths least .. most; what still waits, how many, how many were placed."""
        n_slots = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
        slots = self.gaps.filter(F.col("gap") >= least).select(
            "seq", "gap", n_slots.alias("n"), F.posexplode(F.array_repeat(F.lit(0), n_slots)).alias("slot", "x")
        )
        size = F.when(F.col("slot") < F.col("n") - 1, F.lit(most)).otherwise(F.col("gap") - (F.col("n") - 1) * most)
        both = waiting.select(F.col("length").cast("long").alias("size"), F.lit(False).alias("is_slot"), F.col("item").alias("id"), F.lit(0).alias("slot")).unionByName(
            slots.select(size.cast("long").alias("size"), F.lit(True).alias("is_slot"), F.col("seq").alias("id"), "slot")
        )
        order = ["size", "is_slot", "id", "slot"]
        swept = self._written(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_sweep), SWEPT), "swept")

        counts = swept.groupBy("part").agg(
            F.count(F.when(~F.col("is_slot"), 1)).alias("pieces"), F.count(F.when(F.col("is_slot"), 1)).alias("slots"), F.count("*").alias("n")
        ).collect()
        near = sum(r["n"] for r in counts if r["part"] is None)
        left = sorted((r["part"], r["pieces"], r["slots"]) for r in counts if r["part"] is not None)
        meet = _meet(left)
        far = sum(high - low for _, low, high, _, _ in meet)
        still = sum(n for _, n, _ in left) - far

        matched = swept.filter("part IS NULL").select("item", "length", "seq")
        over = swept.filter("NOT is_slot").select("item", "length", "part", "rank")
        if meet:
            table = self.spark.createDataFrame(meet, "part int, low bigint, high bigint, slot_part int, slot_low bigint")
            # at most twice as many rows as partitions
            over = over.join(F.broadcast(table), (over["part"] == table["part"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select(
                "item", "length", "slot_part", (F.col("slot_low") + F.col("high") - 1 - F.col("rank")).alias("slot_rank")
            )
            free = swept.filter("is_slot").select(F.col("part").alias("slot_part"), F.col("rank").alias("slot_rank"), "seq")
            matched = matched.unionByName(over.join(free, ["slot_part", "slot_rank"]).select("item", "length", "seq"))
            over = over.filter("slot_part IS NULL")
        if near + far:
            matched = self._written(matched, "placed")
            self.placed.append(matched)
            taken = matched.groupBy("seq").agg(F.sum("length").alias("taken"))
            lower = self.gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"))
            self.gaps = self._written(lower.filter("gap > 0"), "gaps")
        return over.select("item", "length"), still, near + far


def pack(items: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """(item, sequence_id, offset) for items (item, length); lengths are 1 to capacity."""
    items = items.select("item", "length")
    state = Packing(items, capacity)
    for c in range(1, classes + 1):
        most = capacity >> c
        floor = most >> 1 if c < classes else 0
        if not most:
            break
        waiting = items.filter((F.col("length") <= most) & (F.col("length") > floor))
        # slots by the longest piece there is, not by the class: six of 680 tokens fit where four of 1024 do
        least, most, n = waiting.agg(F.min("length"), F.max("length"), F.count("*")).first()
        opened = False
        while n:
            waiting, n_left, placed = state.round(waiting, least, most)
            if n_left and placed < WORTH * n:
                tokens, most = waiting.agg(F.sum("length"), F.max("length")).first()
                state.open(-(-n_left // (capacity // most)) if opened else -(-tokens // capacity))
                opened = True
            n = n_left
    placed = state.placed[0]
    for more in state.placed[1:]:
        placed = placed.unionByName(more)
    before = Window.partitionBy("seq").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("item", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, path, capacity, end_id), "pieces")
    return cut.join(pack(cut, capacity), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
