"""Live tables kept by foreachBatch: applications, fill log, saved answers.

A table is a folder of runs.  A micro-batch appends its own rows as one run
and reads nothing; whoever reads the table folds the runs together.  A run is
named after the batches it covers and its number of buckets, and counts once
Spark has marked its write as complete:

    <path>/000000012_000000012_1      rows of batch 12, one bucket
    <path>/000000000_000000011_4      batches 0 to 11, folded, four buckets

* A batch that a complete run covers has no effect when it is replayed; one
  whose write broke off is written anew; one without rows leaves no run.  Batch
  numbers are those of one query, so a table belongs to one query and its checkpoint.
* The newest runs are merged once there are `FANOUT` of them and no older one
  is `FANOUT` times their size, so a row is rewritten a bounded number of
  times on average and the number of runs grows with the logarithm of the table.
  The merged run covers the merged ones; these stay for readers that have
  listed them already and go with the next merge.
* Rows lie in buckets by a hash of the candidate, a power of two that doubles
  when a merge makes buckets larger than `BUCKET_BYTES`.  Reading one candidate
  reads one bucket of each run.  One candidate with very many rows makes one
  large bucket of several files, never one large task: rows are rebalanced.

A fold takes rows and returns fewer rows of the same kind, such that folding
parts first changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave import schemas
from formweave.functions.text import normalize_label
from formweave.operators import tracker as K
from formweave.operators.answers import save_answers

FANOUT = 4
BUCKET_BYTES = 256 << 20
BUCKET = "cand_bucket"

Fold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    path: str
    first: int
    last: int
    buckets: int
    n_bytes: int

    def covers(self, first: int, last: int) -> bool:
        return self.first <= first and last <= self.last


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as the cluster names them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete_runs(spark: SparkSession, path: str) -> list[Run]:
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name, at = status.getPath().getName(), status.getPath()
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            first, last, buckets = map(int, name.split("_"))
            found.append(Run(at.toString(), first, last, buckets, fs.getContentSummary(at).getLength()))
    return found


def current_runs(spark: SparkSession, path: str) -> list[Run]:
    """Complete runs that no other one covers, oldest first."""
    found = _complete_runs(spark, path)
    hidden = lambda r: any(o != r and o.covers(r.first, r.last) for o in found)
    return sorted((r for r in found if not hidden(r)), key=lambda r: r.first)


def _bucket(cand: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(cand), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, first: int, last: int, buckets: int) -> None:
    bucketed = rows.withColumn(BUCKET, _bucket(F.col("cand"), buckets))
    run = f"{path.rstrip('/')}/{first:09}_{last:09}_{buckets}"
    # as many tasks as the rows need; a bucket too large for one is split
    bucketed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(run)
    folder, fs = _folder(rows.sparkSession, run)
    if not fs.getContentSummary(folder).getLength():
        fs.delete(folder, True)


def _rows(spark: SparkSession, runs: list[Run], cand: str | None = None) -> DataFrame:
    """Rows of the runs together; columns that only folded rows have are null in others."""
    parts = []
    for run in runs:
        part = spark.read.parquet(run.path)
        if cand is not None:
            part = part.filter((F.col(BUCKET) == _bucket(F.lit(cand), run.buckets)) & (F.col("cand") == cand))
        parts.append(part.drop(BUCKET))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _newest_of_a_size(runs: list[Run], fanout: int) -> list[Run]:
    """The newest runs back to one that is `fanout` times as large as all after it."""
    total, n = 0, 0
    for run in reversed(runs):
        if n and run.n_bytes >= fanout * total:
            break
        total, n = total + run.n_bytes, n + 1
    return runs[len(runs) - n:]


def _merge(spark: SparkSession, path: str, fold: Fold, fanout: int, bucket_bytes: int) -> None:
    runs = current_runs(spark, path)
    merged = _newest_of_a_size(runs, fanout)
    if len(merged) < fanout:
        return
    for old in set(_complete_runs(spark, path)) - set(runs):
        folder, fs = _folder(spark, old.path)
        fs.delete(folder, True)
    buckets = max(r.buckets for r in merged)
    while sum(r.n_bytes for r in merged) > buckets * bucket_bytes:
        buckets *= 2
    _write(fold(_rows(spark, merged)), path, merged[0].first, merged[-1].last, buckets)


def fold_into(
    path: str, fold: Fold, fanout: int = FANOUT, bucket_bytes: int = BUCKET_BYTES
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends a batch to the table at `path`."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not any(r.covers(batch_id, batch_id) for r in _complete_runs(spark, path)):
            _write(batch, path, batch_id, batch_id, 1)
        _merge(spark, path, fold, fanout, bucket_bytes)

    return apply


def stored_rows(spark: SparkSession, path: str, cand: str | None = None) -> DataFrame:
    """Unfolded rows of the table, or of one candidate; an error where nothing was ever written."""
    runs = current_runs(spark, path)
    if not runs:
        raise FileNotFoundError(f"no rows at {path}")
    return _rows(spark, runs, cand)


def _counted(changes: DataFrame) -> DataFrame:
    """Changes with the number of fills a row stands for: one, unless it was folded."""
    one = F.when(F.col("op") == "filled", F.lit(1)).otherwise(0).cast("long")
    fills = F.coalesce("fills", one) if "fills" in changes.columns else one
    return changes.withColumn("fills", fills)


def applications_fold(changes: DataFrame) -> DataFrame:
    """A few change rows per URL that give the same applications as all of them."""
    return K.compact_changes(_counted(changes))


def fill_log_fold(entries: DataFrame) -> DataFrame:
    """The newest entries per candidate, each id once."""
    return K.fill_log(entries.dropDuplicates(["cand", "id"]))


def answers_fold(saves: DataFrame) -> DataFrame:
    """The first and the last save of each question: all that saving in order depends on."""
    order = F.struct("ts_us", "seq")
    keyed = saves.withColumn("key", normalize_label(F.col("question")))
    ends = keyed.groupBy("cand", "key").agg(
        F.min_by(F.struct(*saves.columns), order).alias("first"), F.max_by(F.struct(*saves.columns), order).alias("last")
    )
    kept = F.array_distinct(F.array("first", "last"))
    return ends.select(F.inline(kept)).select(*saves.columns)


def live_applications(spark: SparkSession, path: str, cand: str | None = None) -> DataFrame:
    """The applications of the changes at `path`, of all candidates or one."""
    return K.applications(_counted(stored_rows(spark, path, cand)))


def live_fill_log(spark: SparkSession, path: str, cand: str | None = None) -> DataFrame:
    """The newest log entries of each candidate, or of one."""
    return fill_log_fold(stored_rows(spark, path, cand))


def live_answers(spark: SparkSession, path: str, cand: str | None = None) -> DataFrame:
    """The answers after all saves at `path`, of all candidates or one."""
    none = spark.createDataFrame([], schemas.ANSWERS)
    return save_answers(answers_fold(stored_rows(spark, path, cand)), none)


def milestones(changes: DataFrame) -> DataFrame:
    """Usage events that application changes give rise to, first ones marked once.

    changes as in operators/tracker.py.
    """
    c = F.col
    pairs = {
        "detected": ("application_page_detected", "first_application_detected"),
        "filled": ("fill_completed", "first_fill_completed"),
        "applied": ("application_marked_applied", "first_application_marked"),
    }
    counts = {"field_count": c("field_count"), "filled": c("filled"), "reviewed": c("reviewed"), "failed": c("failed")}
    ats = {"ats": c("ats")}
    events = []
    for op, (plain, first) in pairs.items():
        params = {**ats, **(counts if op == "filled" else {})}
        body = F.to_json(F.struct(*[v.alias(k) for k, v in params.items()]))
        events += [
            F.when(c("op") == op, F.struct(F.lit(name).alias("event"), body.alias("params_json"), F.lit(once).alias("once")))
            for name, once in ((plain, False), (first, True))
        ]
    return changes.withColumn("e", F.explode(F.array_compact(F.array(*events)))).select(
        c("cand").alias("client_id"), c("seq").alias("event_id"), "ts_us", "e.*"
    )
