"""Repeated passages: a suffix array's threshold-bounded intervals, for any number of texts.

Every byte that lies in a string of `length` bytes that also starts earlier
is removed; earlier is a smaller doc_id or an earlier start in one text.

One suffix array of all texts can't be shared by many machines, so strings
are dealt out first.  Each string of `length` bytes has an anchor: among its
stretches of ANCHOR bytes the one with the least hash, the first of equals.
Equal strings have equal anchors at equal places.  Neighbouring strings
mostly share an anchor, so a text falls into runs of starts, a run being
`length` bytes and one more for each further start.

1. Anchors that occur in one place only can't belong to a repeat.  Each task
   settles those that it has in several texts itself and passes on one row
   an anchor; a count over these rows finds the rest.
2. Texts with repeated anchors give their runs.  Equal runs of one task are
   one; the later ones are repeats as a whole.
3. Runs meet by anchor, so all equal strings are in one task.  A block of
   anchors there becomes one text.  From its suffix array and
   Burrows-Wheeler transform the common prefixes of neighbouring suffixes
   are derived by increasing value: intervals of all strings of 0, 1, 2, ...
   bytes are extended backwards, breadth first, and an extension whose end
   has no value yet gets the current one.  After `length` steps whatever has
   no value has at least `length` bytes in common.
4. Anchors with very many different runs (a frequent line, always in other
   company) would make a large block: their strings are compared one by one,
   by two 64-bit hashes, grouped in Spark with map-side combining.
5. The starts found come back to their text, which drops the bytes they cover.

Equal whole texts need none of this: the one with the smallest doc_id stands
for all, and the others are removed as a whole if they have `length` bytes.

Defined cases: a null or empty text loses nothing (null stays null); texts
shorter than `length` lose nothing; rows that repeat a doc_id with equal text
are no copies of each other: they stay or lose the same passages alike;
with different texts they are ordered by a hash of the text; rows
without a doc_id are kept whole and count for nothing; bytes that are not
whole characters after a removal are left as they are in `kept` (binary);
an empty table gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.bytewords import _VALUES, _powers, mix, text_chunks
from formweave.llm.shared import lean, new_folder, written

LENGTH = 100
ANCHOR = 25
#: Text of a block, in bytes, unless one anchor alone has more; a task has one block at a time.
BLOCK_BYTES = 1 << 20
#: Runs of an anchor from which on its strings are compared one by one.
HOT_RUNS = 10_000
#: Runs that a task folds before it passes them on.
FOLD = 100_000


def anchored_runs(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(text, start, starts, hash): the runs of starts with one anchor, of each text of a chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    h = mix((total[anchor:] - total[:-anchor]) * down[: n + 1 - anchor])
    # equal hashes (their upper bits) go to the first place
    bits = np.uint64(max(22, n.bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    window, width = length - anchor + 1, 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
    place = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place[start + offsets[text]]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return text[first], start[first], np.diff(np.append(first, len(text))), h[at[first]]


def _anchor_rows(batches, length: int):
    """(a, doc, known): one row for each anchor of a task, or for each text that has it where several have."""
    def settled(anchors, docs, known):
        a, d, k = np.concatenate(anchors), np.concatenate(docs), np.concatenate(known)
        order = np.argsort(a, kind="stable")
        a, d, k = a[order], d[order], k[order]
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = a[1:] == a[:-1]
        k = k | same[1:] | same[:-1]
        yield from (
            pa.RecordBatch.from_arrays(
                [pa.array(a[i : i + 50_000].view(np.int64)), pa.array(d[i : i + 50_000]), pa.array(k[i : i + 50_000]), pa.array(~same[:-1][i : i + 50_000])],
                names=["a", "doc", "known", "first"],
            )
            for i in range(0, len(a), 50_000)
        )

    anchors, docs, known, held = [], [], [], 0
    for batch in batches:
        names = batch["doc"].to_numpy(zero_copy_only=False)
        for row, offsets, data in text_chunks(batch["text"]):
            text, _, _, h = anchored_runs(offsets, data, length)
            # once a text, and known if twice in it
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            again = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
            keep, twice = np.ones(len(h), bool), np.zeros(len(h), bool)
            keep[1:] = ~again
            # the rows of a text's anchor are neighbours: the first one knows of the second
            twice[:-1] = again
            anchors.append(h[keep])
            docs.append(names[row + text[keep]])
            known.append(twice[keep])
            held += len(anchors[-1])
        if held > 4_000_000:
            yield from settled(anchors, docs, known)
            anchors, docs, known, held = [], [], [], 0
    if held:
        yield from settled(anchors, docs, known)


def repeated_anchors(named: DataFrame, length: int) -> DataFrame:
    """(doc, anchors): for each text the anchors that are elsewhere too; named: doc, text."""
    rows = named.mapInArrow(lean(partial(_anchor_rows, length=length)), "a bigint, doc bigint, known boolean, first boolean")
    # of what a task has settled only the first row meets other tasks' rows
    dealt = rows.withColumn("key", F.when(F.col("first"), F.col("a")).otherwise(F.xxhash64("a", "doc")))
    met = dealt.withColumn("n", F.count("*").over(Window.partitionBy("key", "first")))
    return met.filter("known OR n > 1").groupBy("doc").agg(F.collect_set("a").alias("anchors"))


def _run_rows(batches, length: int):
    """(a, run, doc, text_key, start, starts): runs with a repeated anchor; a is null where the run is known to be a repeat."""
    found: dict[tuple[int, bytes], list] = {}

    def folded():
        rows = []
        for (a, run), places in found.items():
            first = min(places)
            rows.append((a, run, *first, len(run) - length + 1))
            rows += [(None, None, *p, len(run) - length + 1) for p in places if p != first]
        for i in range(0, len(rows), 20_000):
            columns = list(zip(*rows[i : i + 20_000], strict=True))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "run", "doc", "text_key", "start", "starts"])

    held = 0
    for batch in batches:
        docs, keys = batch["doc"].to_pylist(), batch["text_key"].to_pylist()
        lists = batch["anchors"]
        for row, offsets, data in text_chunks(batch["text"]):
            text, start, starts, h = anchored_runs(offsets, data, length)
            wanted = lists.slice(row, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.isin(h, wanted)
            whole = data.tobytes()
            begin = offsets[text[hit]] + start[hit]
            end = begin + starts[hit] + length - 1
            for t, s, a, b, e in zip(text[hit].tolist(), start[hit].tolist(), h[hit].view(np.int64).tolist(), begin.tolist(), end.tolist(), strict=True):
                found.setdefault((a, whole[b:e]), []).append((docs[row + t], keys[row + t], s))
                held += 1
        if held > FOLD:
            yield from folded()
            found, held = {}, 0
    yield from folded()


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text in order of their first `depth` symbols or more; ends (places of separators) differ from all else, and come first.

    Sorted by eight symbols first, and then by twice as many each time, only
    what is not told apart yet.  A suffix with a separator among the first
    eight symbols is told apart by it at once.
    """
    n, width = len(text), 8
    is_end = np.zeros(n + width, bool)
    is_end[ends] = True
    ends = ends.astype(np.int32)
    separator = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=np.int32(-1)))
    to_end = ends[separator] - np.arange(n, dtype=np.int32)
    packed = np.zeros(n, np.uint64)
    padded = np.append(text, np.zeros(width, np.uint8))
    for i in range(width):
        # what follows a separator counts for nothing, and a separator is less than a zero byte
        packed <<= np.uint64(8)
        packed |= np.where(to_end > i, padded[i : i + n], np.uint8(0))
    # shorter suffixes first where bytes are equal, then by separator
    last = np.where(to_end < width, to_end * np.int64(len(ends) + 1) + separator, np.iinfo(np.int64).max)
    del separator, to_end, padded
    order = np.lexsort((last, packed)).astype(np.int32)
    ends_first = is_end[order]
    order = np.concatenate([order[ends_first], order[~ends_first]])
    new = np.ones(n, bool)
    new[1:] = (packed[order[1:]] != packed[order[:-1]]) | (last[order[1:]] != last[order[:-1]])
    del packed, last
    # a rank is where the suffixes that are alike so far begin
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    open_ = ~new
    open_[:-1] |= ~new[1:]
    slots = np.flatnonzero(open_)
    while width < depth and len(slots):
        some = order[slots]
        key = rank[some] * np.int64(n + 1) + np.where(some + width < n, rank[np.minimum(some + width, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[some] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alike = ~new
        alike[:-1] |= ~new[1:]
        slots = slots[alike]
        width *= 2
    return order


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order has at least `length` symbols in common with the one before it.

    Breadth-first backward extension on the Burrows-Wheeler transform: the
    interval of a string w is extended to those of c w for all symbols c
    before it.  The interval of c w ends where a common prefix of |w| ends,
    unless a shorter one was found there before.
    """
    n, m = len(text), len(ends)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    before = order - 1  # -1, the last, is a separator
    stop = is_end[before]
    bwt = np.where(stop, np.int16(-1), text[before].astype(np.int16))
    # place of each suffix's extension: equal symbols keep their order
    extension = np.empty(n, np.int32)
    extension[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)  # separators first, as in the order
    symbol = np.where(is_end[order], np.int16(-1), text[order].astype(np.int16))
    del before, bwt
    known = np.zeros(n + 1, bool)
    known[: m + 1] = True
    known[n] = True
    owner = np.empty(n, np.int32)
    low, high = np.array([0]), np.array([n])
    for size in range(length):
        if size == 1:
            # strings of one separator
            low, high = np.append(low, np.arange(m)), np.append(high, np.arange(1, m + 1))
        if not len(low):
            break
        sizes = high - low
        rows = np.repeat((low - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        rows += np.arange(len(rows), dtype=np.int32)
        ids = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        open_ = ~stop[rows]
        at, ids = extension[rows[open_]], ids[open_]
        owner[at] = ids
        if len(at) * 8 > n:
            mask = np.zeros(n, bool)
            mask[at] = True
            at = np.flatnonzero(mask)
        else:
            at = np.sort(at)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (symbol[at[1:]] != symbol[at[:-1]])
        first = np.flatnonzero(new)
        low, high = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return ~known[:n]


def repeated_starts(runs: list[bytes], places: list[tuple], length: int) -> list[tuple]:
    """(doc, text_key, start, starts) of the strings of runs that have an equal one at a smaller place.

    places: (doc, text_key, start) of each run.
    """
    sizes = np.array([len(r) for r in runs])
    text = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    order = suffix_order(text, ends, length)
    joined = common_prefixes(text, ends, order, length)
    if not joined.any():
        return []
    cluster = np.cumsum(~joined)
    member = joined.copy()
    member[:-1] |= joined[1:]
    at, cluster = order[member], cluster[member]
    run = np.searchsorted(ends, at)
    inside = at - (ends[run] - sizes[run])
    # order of runs by place, then of strings: start counts only within one text
    by_place = sorted(range(len(places)), key=lambda i: places[i][:2])
    level, levels = np.zeros(len(places), np.int64), 0
    for i, j in zip(by_place, by_place[1:], strict=False):
        levels += places[i][:2] != places[j][:2]
        level[j] = levels
    start = np.array([p[2] for p in places])[run] + inside
    by = np.lexsort((start, level[run], cluster))
    late = np.zeros(len(by), bool)
    late[1:] = cluster[by[1:]] == cluster[by[:-1]]
    hit = by[late]
    hit = hit[np.lexsort((inside[hit], run[hit]))]
    out = []
    r, s = run[hit], inside[hit]
    if len(hit):
        new = np.ones(len(hit), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        for i, n in zip(first.tolist(), np.diff(np.append(first, len(hit))).tolist(), strict=True):
            doc, key, begin = places[r[i]]
            out.append((doc, key, begin + int(s[i]), n))
    return out


STARTS = "doc bigint, text_key bigint, start bigint, starts bigint"


def _starts_batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "text_key", "start", "starts"])


def _block_rows(batches, length: int, block_bytes: int):
    """Runs sorted by anchor, run and place to STARTS; a block holds block_bytes, or else one anchor."""
    runs, places, out, held = [], [], [], 0
    #: where the anchor at work begins, and the bytes of the anchors before it
    group_first, settled, anchor, last = 0, 0, None, None
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("a", "run", "doc", "text_key", "start", "starts"))
        for a, run, doc, key, start, starts in zip(*columns, strict=True):
            if a != anchor:
                # an anchor with one run has nothing to be compared
                if len(runs) == group_first + 1:
                    held -= len(runs.pop())
                    places.pop()
                anchor, last, group_first, settled = a, None, len(runs), held
            if run == last:
                if (doc, key, start) != places[-1]:  # else a repeated row
                    out.append((doc, key, start, starts))
            else:
                runs.append(run)
                places.append((doc, key, start))
                held += len(run)
                last = run
                if held > block_bytes and group_first:
                    # what came before this anchor makes a block
                    out += repeated_starts(runs[:group_first], places[:group_first], length)
                    runs, places, held = runs[group_first:], places[group_first:], held - settled
                    group_first, settled = 0, 0
            if len(out) > 50_000:
                yield _starts_batch(out)
                out = []
    if len(runs) == group_first + 1:
        runs.pop()
        places.pop()
    if runs:
        out += repeated_starts(runs, places, length)
    yield _starts_batch(out)


def _one_by_one(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many runs, a string a row."""
    each = rows.select("doc", "text_key", "start", "run", F.explode(F.sequence(F.lit(0), (F.col("starts") - 1).cast("int"))).alias("i"))
    string = F.substring(F.col("run"), F.col("i") + 1, F.lit(length))
    strings = each.select(
        F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(7), string).alias("h2"), "doc", "text_key", (F.col("start") + F.col("i")).alias("start")
    )
    firsts = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_key", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    late = strings.join(firsts, ["h1", "h2"]).filter("struct(doc, text_key, start) <> f")
    return late.select("doc", "text_key", "start", F.lit(1).cast("bigint").alias("starts"))


def _cut_rows(batches, length: int, as_text: bool):
    """docs with starts to (.., kept, n_removed, n_spans)."""
    for batch in batches:
        kept, removed, spans = [], [], []
        values = (batch[c].to_pylist() for c in ("__bytes", "__starts", "__copy"))
        for text, starts, copy in zip(*values, strict=True):
            if copy and text is not None and len(text) >= length:
                starts = [{"start": 0, "starts": len(text) - length + 1}]
            if not starts:
                kept.append(text)
                removed.append(0)
                spans.append(0)
                continue
            at, n, parts, gone = 0, 0, [], 0
            until = -1
            for begin, more in sorted((s["start"], s["starts"]) for s in starts):
                if begin > until:
                    n += 1
                    parts.append(text[at:begin])
                    until = begin
                end = begin + more + length - 1
                if end > until:
                    gone += end - until
                    until = end
                at = until
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(n)
        rest = [c for c in batch.schema.names if c not in ("__bytes", "__starts", "__copy")]
        left = [None if k is None else k.decode("utf-8", "ignore") for k in kept] if as_text else kept
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in rest), pa.array(left, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
            names=[*rest, "kept", "n_removed", "n_spans"],
        )


def repeats(docs: DataFrame, length: int = LENGTH, hot_runs: int = HOT_RUNS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(STARTS, copies): starts of repeated strings in distinct texts, and (doc, text_key) of texts that a smaller doc_id has too."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "repeats")
    text = F.col("text")
    named = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(7), text).alias("second"), text.alias("text")
    )
    keys = written(named.select("doc", "text_key", "second"), "texts", folder)
    firsts = keys.groupBy("text_key", "second").agg(F.min("doc").alias("owner"))
    copies = written(keys.join(firsts, ["text_key", "second"]).filter("doc <> owner").select("doc", "text_key").distinct(), "copies", folder)

    copied = copies.groupBy("doc").agg(F.collect_set("text_key").alias("copied"))
    anchors = repeated_anchors(named.select("doc", "text"), length).join(copied, "doc", "left")
    is_copy = F.coalesce(F.array_contains("copied", F.col("text_key")), F.lit(False))
    owned = named.select("doc", "text_key", "text").join(anchors, "doc").filter(~is_copy).drop("copied")
    runs = written(owned.mapInArrow(lean(partial(_run_rows, length=length)), "a bigint, run binary, doc bigint, text_key bigint, start bigint, starts bigint"), "runs", folder)

    hot = runs.filter("a IS NOT NULL").groupBy("a").count().filter(F.col("count") > hot_runs).select("a", F.lit(True).alias("hot"))
    hot = written(hot, "hot", folder)
    marked = runs.filter("a IS NOT NULL").join(hot, "a", "left")
    order = ["a", "run", "doc", "text_key", "start"]
    cold = marked.filter("hot IS NULL").drop("hot").repartition("a").sortWithinPartitions(*order)
    found = cold.mapInArrow(lean(partial(_block_rows, length=length, block_bytes=block_bytes)), STARTS)
    whole = runs.filter("a IS NULL").select("doc", "text_key", "start", "starts")
    starts = found.unionByName(whole).unionByName(_one_by_one(marked.filter("hot"), length))
    return written(starts, "starts", folder), copies


def cut_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, **options) -> DataFrame:
    """docs with kept (what is left of the text's UTF-8 bytes), n_removed and n_spans.

    kept is binary, or with `as_text` a string without the halves of
    characters at the cuts.
    """
    columns = [c for c in docs.columns if c not in ("kept", "n_removed", "n_spans")]
    starts, copies = repeats(docs, length, **options)
    lists = starts.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "starts")).alias("__starts"))
    known = lists.join(copies.withColumn("__copy", F.lit(True)), ["doc", "text_key"], "full")
    known = known.withColumnsRenamed({"doc": "__doc", "text_key": "__key"})
    on = (docs["doc_id"].cast("long") == known["__doc"]) & (F.xxhash64(docs["text"]) == known["__key"])
    joined = docs.select(*columns).join(known, on, "left").drop("__doc", "__key").withColumn("__bytes", F.col("text").cast("binary"))
    made = [
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    ]
    schema = T.StructType([*docs.select(*columns).schema.fields, *made])
    return joined.mapInArrow(lean(partial(_cut_rows, length=length, as_text=as_text)), schema)
