"""Session settings the operators are tuned for."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of texts and pages are dear to process: more and smaller scan tasks
    "spark.sql.files.maxPartitionBytes": "16m",
    # list states and timers of streams
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # checkpoint files go when the data frames they belong to are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "formweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Only where none is named and driver and executors are one process (as in
    a local trial) a folder inside the session's warehouse is used.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of what nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which may be
    long after the job that made them, when the next one's are written.  The
    first collection ends what holds on to the last job, the second finds its
    shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
