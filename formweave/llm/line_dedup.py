"""Repeated lines, found with levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that hold the
line and the document that keeps it.  Documents come in batches from the
largest ids down.  The lines of a batch are anti-joined with the runs: what
no run holds is new, and its largest document is the keeper; what some run
holds only adds to the count.  Both form the batch's own run on level 0.
When a level has `fanout` runs, they are merged into one run of the next
level.  So a line hash is rewritten once a level, not once a batch.

All joins and aggregations are on a 128-bit hash of the line, texts are not
shuffled for them.  Counting goes by (line, document) first and by line
second with map-side sums, so a line of a third of all documents is spread;
the join that hands the keeper back to the lines is a plain join that
adaptive execution may split.

Only DataFrame operations are used.

Defined cases: null or empty text is one empty line; lines shorter than
`min_chars` are never dropped; several equal lines of one document count as
one document and stay or go together; rows that repeat a doc_id count as one
document; rows without a doc_id keep all their lines and count for nothing;
an empty table gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.shared import BLANKS, ascii_lower, new_folder, whole_text, written

HASH = ["__h1", "__h2"]
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 3
FANOUT = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__doc, __text, __pos, __h1, __h2): lines whose key is long enough. __text tells apart rows of one id."""
    text = whole_text()
    lines = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__text"), F.posexplode(F.split(text, "\n")).alias("__pos", "__line")
    )
    key = F.col("__key")
    return (
        lines.withColumn("__key", line_key(F.col("__line")))
        .filter(F.length(key) >= min_chars)
        # two hashes with different seeds
        .select("__doc", "__text", "__pos", F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(7), key).alias("__h2"))
    )


class LineRuns:
    """The runs, as tables in one shared folder.  Run rows: __h1, __h2, n_docs, keeper."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.folder, self.fanout, self.made = new_folder(spark, "line-runs"), fanout, 0
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> DataFrame | None:
        found = [run for level in self.levels for run in level]
        out = found[0] if found else None
        for run in found[1:]:
            out = out.unionByName(run)
        return out

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        run = written(rows.sortWithinPartitions(*HASH), f"level{level}-run{self.made}", self.folder)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = compact(self.runs_of(level))
            self.levels[level] = []
            self._write(merged, level + 1)

    def runs_of(self, level: int) -> DataFrame:
        first, *rest = self.levels[level]
        for run in rest:
            first = first.unionByName(run)
        return first

    def add(self, lines: DataFrame) -> None:
        """lines: __h1, __h2, __doc. Batches must come from the largest documents down."""
        batch = lines.select(*HASH, "__doc").distinct().groupBy(*HASH).agg(
            F.count("*").alias("n_docs"), F.max("__doc").alias("keeper")
        )
        known = self.runs()
        if known is not None:
            batch = written(batch, f"batch{self.made}", self.folder)
            old = known.select(*HASH).hint("merge")
            fresh = batch.join(old, HASH, "left_anti")
            again = batch.join(old, HASH, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.unionByName(again)
        self._write(batch, 0)


def compact(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(__doc, __text, __drops): for each document that loses lines their positions from 0."""
    spark = docs.sparkSession
    lines = written(line_rows(docs, min_chars).withColumn("__doc", F.col("__doc").cast("long")), "lines")
    low, high = lines.agg(F.min("__doc"), F.max("__doc")).first()
    low, high = low or 0, high or 0
    cuts = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
    runs = LineRuns(spark, fanout)
    for start, end in reversed(list(zip(cuts, cuts[1:], strict=False))):
        runs.add(lines.filter((F.col("__doc") >= start) & (F.col("__doc") < end)))
    repeated = compact(runs.runs()).filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper")
    lost = lines.join(written(repeated, "repeated", runs.folder), HASH).filter("__doc <> keeper")
    return lost.groupBy("__doc", "__text").agg(F.collect_set("__pos").alias("__drops"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text less its repeated lines, and n_lines (before), n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower
    case.  Keys of at least `min_chars` code points that at least `min_docs`
    documents hold stay only in the largest doc_id holding them.
    """
    text = whole_text()
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = dropped_lines(docs, **options)
    on = (docs["doc_id"].cast("long") == drops["__doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == drops["__text"])
    joined = docs.join(drops, on, "left").drop("__doc", "__text")
    n, d = F.size(F.split(text, "\n")), F.coalesce(F.size("__drops"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drops"))
    # the outer transform has one element, the lines: they are split once, not once a line
    kept = F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(stay, lambda i: F.get(lines, i)))
    return (
        joined.withColumn("n_lines", n.cast("long"))
        .withColumn("n_dropped", F.when(F.col("__drops").isNull(), 0).otherwise(d).cast("long"))
        .withColumn("text", F.when(F.col("__drops").isNull(), F.col("text")).otherwise(F.array_join(kept[0], "\n")))
        .select(*columns, "n_lines", "n_dropped")
    )
