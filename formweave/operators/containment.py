"""Which phrases stand in which texts, for any number of both.

An inverted index of windows of `WIDTHS` bytes of UTF-8.  A phrase is
kept under a single one of its widest windows, the one the fewest texts have; a
text meets phrases under its windows of every width, and `contains` decides.
Nothing is lost: a text that contains a phrase has all windows of it.

Windows are numbers made by numpy in the tasks, all of a stretch of texts at
once.  They are counted there by hash buckets; counts are scalar subqueries,
so no job runs while a plan is built, and also say in how many parts each side
of a frequent window is dealt out.

`contained_pairs` is for short texts: they go with their windows to the
phrases, under buckets in use.  `candidates` is for texts of any length: tasks
over texts get the windows in use as bits, beside their first row (those of any
phrase for counting, those that phrases are kept under for sending), and a text
goes to its windows' phrases and back as a number of `ID_BITS`.  Texts of one
number are told apart where they are tested.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.operators.spread import growing, spread

#: Bytes of windows, 8 at most; narrow ones serve short phrases, wide ones are rarer.
WIDTHS = (1, 2, 3, 4, 6, 8)
#: Hash buckets in which windows are counted, a power of two.
BUCKETS = 1 << 16
#: Bits of a window's number; the rest of 64 tell apart the texts of a stretch.
BITS = 40
#: Bytes of texts that are worked on at once, unless one has more.
STRETCH = 1 << 18
#: Rows of one window that meet in one task, of each side.
PART_ROWS = 4096
#: Numbers of 64 bits that tell which windows are in use, a power of two.
WORDS = 1 << 18
#: Bits of a text's number: few bytes to send, and few texts share one.
ID_BITS = 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(batch: pa.RecordBatch, column: str):
    """(first row, byte offsets, bytes, group hashes) of stretches of a batch's rows."""
    if not len(batch):
        return
    texts, groups = batch[column], batch["g"].to_numpy().view(np.uint64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + STRETCH, "right")) - 1)
        # the number of texts leaves room for that of a window
        end = min(end, first + (1 << 64 - BITS) - 1)
        yield first, at[first : end + 1] - at[first], whole[at[first] : at[end]], groups[first:end]
        first = end


def _numbers(offsets: np.ndarray, data: np.ndarray, groups: np.ndarray, widest: bool, used: np.ndarray | None = None) -> np.ndarray:
    """(text << BITS) | window of all windows of texts, with repeats; of each text all widths, or the widest that it has; of `used` bits only."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = offsets[1:][owner] - np.arange(len(data))
    packed, done, found = np.zeros(len(data), np.uint64), 0, []
    for width, wider in zip(WIDTHS, [*WIDTHS[1:], None], strict=True):
        for i in range(done, min(width, len(data))):
            packed[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
        done = width
        fits = left >= width
        if widest and wider:
            fits &= sizes[owner] < wider
        text = owner[fits]
        salt = _mix(groups + np.uint64(width))
        h = _mix(packed[fits] ^ salt[text]) >> np.uint64(64 - BITS)
        if used is not None:
            at = h & np.uint64(64 * len(used) - 1)
            some = ((used[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            text, h = text[some], h[some]
        found.append((text.astype(np.uint64) << np.uint64(BITS)) | h)
    return np.concatenate(found)


def _window_rows(batches, column: str, widest: bool):
    """Rows with e, the distinct windows of their text."""
    for batch in batches:
        for first, offsets, data, groups in _stretches(batch, column):
            found = np.sort(_numbers(offsets, data, groups, widest))
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            found = found[new]
            cuts = np.searchsorted(found, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
            windows = (found & np.uint64((1 << BITS) - 1)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(windows))
            rows = batch.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([rows["grp"], rows[column], lists], names=["grp", column, "e"])


def _with_used(batches):
    """Batches with the bits of the windows in use, which come beside a task's first row; none without such a column."""
    used = None
    for batch in batches:
        if used is None and "used" in batch.schema.names and len(batch):
            used = batch["used"][0].values.to_numpy().view(np.uint64)
        yield batch, used


def _seen_rows(batches):
    """(a, e): the distinct windows in use of each text, by its number."""
    for batch, used in _with_used(batches):
        ids = batch["a"].to_numpy()
        for first, offsets, data, groups in _stretches(batch, "text"):
            found = np.unique(_numbers(offsets, data, groups, False, used))
            text = (found >> np.uint64(BITS)).view(np.int64)
            windows = (found & np.uint64((1 << BITS) - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + text]), pa.array(windows)], names=["a", "e"])


def _count_rows(batches):
    """(id, n): how many windows, of those in use, a task's texts have in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch, used in _with_used(batches):
        for _, offsets, data, groups in _stretches(batch, "text"):
            found = _numbers(offsets, data, groups, False, used) & np.uint64(BUCKETS - 1)
            total += np.bincount(found.view(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _with_group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("g", F.xxhash64("grp"))


def _windows(rows: DataFrame, column: str, widest: bool) -> DataFrame:
    """(grp, column, e): a row for each distinct window."""
    schema = T.StructType([rows.schema["grp"], rows.schema[column], T.StructField("e", T.ArrayType(T.LongType()))])
    made = _with_group(rows).mapInArrow(partial(_window_rows, column=column, widest=widest), schema)
    return made.withColumn("e", F.explode("e"))


def _bucket(e: Column) -> Column:
    return e.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _by_number(rows: DataFrame, size: int, total) -> Column:
    """An array of `size` values (id, n), those of an id folded by total, 0 where there are none."""
    none = rows.sparkSession.range(size).select("id", F.lit(0).cast("long").alias("n"))
    folded = rows.groupBy("id").agg(total("n").alias("n")).union(none).groupBy("id").agg(total("n").alias("n"))
    return folded.agg(F.sort_array(F.collect_list(F.struct("id", "n")))["n"]).scalar()


def _summed(counts: DataFrame) -> Column:
    """An array of counts (id, n) by bucket."""
    return _by_number(counts, BUCKETS, F.sum)


def bits_of(hashes: DataFrame, words: int) -> Column:
    """An array of numbers whose bits say which hashes there are, by the last bits of column e."""
    e = F.col("e")
    word = F.shiftright(e, 6).bitwiseAND(F.lit(words - 1)).alias("id")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)).cast("int")).alias("n")
    return _by_number(hashes.select(word, one), words, F.bit_or)


def has_bit(bits: Column, e: Column, words: int) -> Column:
    """Whether the bit of a hash is set."""
    word = F.get(bits, F.shiftright(e, 6).bitwiseAND(F.lit(words - 1)).cast("int"))
    return F.getbit(word, e.bitwiseAND(F.lit(63)).cast("int")) == 1


def beside_first(value: Column) -> Column:
    """The value in the first row of each task, null in the others."""
    return F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, value)


def _parts(count: Column) -> Column:
    return F.greatest(F.ceil(count / PART_ROWS).cast("int"), F.lit(1))


def number_of(grp: Column, text: Column) -> Column:
    """A text's number in its group."""
    return F.xxhash64(grp, text).bitwiseAND(F.lit((1 << ID_BITS) - 1))


def numbered(texts: DataFrame) -> DataFrame:
    """(a, g, grp, text): the distinct texts, dealt out by their number a; null and empty ones and those without a group are left out."""
    some = texts.select("grp", "text").filter("grp IS NOT NULL AND text <> ''")
    sets = some.groupBy(number_of(F.col("grp"), F.col("text")).alias("a")).agg(F.collect_set(F.struct("grp", "text")).alias("t"))
    return sets.select("a", F.explode("t").alias("t")).select("a", F.xxhash64("t.grp").alias("g"), "t.grp", "t.text")


def candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(a, grp, phrase, ...): numbers of texts that may contain a phrase, with all columns of phrases.

    texts: as `numbered`; phrases: grp, phrase, distinct, and any others.
    By chance a pair may come more than once.
    """
    some = phrases.filter("grp IS NOT NULL AND phrase <> ''")
    # windows are dear to make
    every = _windows(spread(some.select("grp", "phrase"), "grp", "phrase"), "phrase", widest=True)
    beside = lambda bits: texts.withColumn("used", beside_first(bits))
    n_texts = _summed(beside(bits_of(every, WORDS)).select("g", "text", "used").mapInArrow(_count_rows, "id bigint, n bigint"))

    rarest = (
        every.withColumn("n", F.get(n_texts, _bucket(F.col("e"))))
        .groupBy("grp", "phrase").agg(F.min(F.struct("n", "e")).alias("kept"))
        .filter("kept.n > 0")
        .select("grp", "phrase", "kept.e", "kept.n")
    )
    n_phrases = _summed(rarest.select(_bucket(F.col("e")).cast("long").alias("id"), F.lit(1).cast("long").alias("n")))
    seen = beside(bits_of(rarest, WORDS)).select("a", "g", "text", "used").mapInArrow(_seen_rows, "a bigint, e bigint")

    count_t, count_p = F.get(n_texts, _bucket(F.col("e"))), F.get(n_phrases, _bucket(F.col("e")))
    parts_of = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    # a window and the parts of both sides in 32 bits: what meets by chance is tested like all others
    met = F.hash("e", "i", "j").alias("k")
    left = (
        seen.withColumn("p", count_p).filter("p > 0")
        .select("a", "e", F.pmod(F.hash("a"), _parts(count_t)).alias("i"), parts_of(_parts(F.col("p"))).alias("j"))
        .select("a", met)
    )
    right = (
        rarest.select("grp", "phrase", "e", F.pmod(F.hash("phrase"), _parts(count_p)).alias("j"), parts_of(_parts(F.col("n"))).alias("i"))
        .select("grp", "phrase", met)
    )
    if len(phrases.columns) > 2:
        right = right.join(some, ["grp", "phrase"])
    return left.join(growing(right), "k").drop("k")


def contained_pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(grp, text, phrase): each pair of one group, once, whose text contains the phrase.

    texts: grp, text; phrases: grp, phrase.  Rows may repeat; null and empty
    texts and phrases are in no pair, nor are rows without a group.
    """
    # windows are dear to make, so distinct rows are dealt out before
    texts = spread(texts.select("grp", "text").filter("grp IS NOT NULL AND text <> ''").distinct(), "grp", "text")
    phrases = spread(phrases.select("grp", "phrase").filter("grp IS NOT NULL AND phrase <> ''").distinct(), "grp", "phrase")
    seen = _windows(texts, "text", widest=False)
    n_texts = _summed(_with_group(texts).mapInArrow(_count_rows, "id bigint, n bigint"))

    # the aggregation follows that shuffle
    rarest = (
        _windows(phrases, "phrase", widest=True)
        .withColumn("n", F.get(n_texts, _bucket(F.col("e"))))
        .groupBy("grp", "phrase").agg(F.min(F.struct("n", "e")).alias("kept"))
        .filter("kept.n > 0")
        .select("grp", "phrase", "kept.e", "kept.n")
    )
    n_phrases = _summed(rarest.select(_bucket(F.col("e")).cast("long").alias("id"), F.lit(1).cast("long").alias("n")))

    count_t, count_p = F.get(n_texts, _bucket(F.col("e"))), F.get(n_phrases, _bucket(F.col("e")))
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    left = (
        seen.withColumn("p", count_p).filter("p > 0")
        .select("grp", "text", "e", F.pmod(F.hash("text"), _parts(count_t)).alias("i"), _parts(F.col("p")).alias("parts"))
        .select("grp", "text", "e", "i", every(F.col("parts")).alias("j"))
    )
    right = (
        rarest.select("grp", "phrase", "e", F.pmod(F.hash("phrase"), _parts(count_p)).alias("j"), _parts(F.col("n")).alias("parts"))
        .select("grp", "phrase", "e", every(F.col("parts")).alias("i"), "j")
    )
    return left.join(right, ["grp", "e", "i", "j"]).filter(F.contains("text", "phrase")).select("grp", "text", "phrase")
