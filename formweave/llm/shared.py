"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import suppress
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only white space of contracts on words and lines: space, tab, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only where it is unset and driver and executors are one process (tests)
    a folder in the warehouse takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, safe from lost executors, without lineage."""
    path = f"{folder}/{name}" if folder else new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would also change other scripts."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole_text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def kept(sent, make):
    """make(a broadcast dictionary), made once in a worker and kept there from task to task.

    The dictionary holds built-in values only: what is broadcast is not sent by value.
    """
    if "made" not in sent.value:
        sent.value["made"] = make(sent.value)
    return sent.value["made"]


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _leanly(batches, make):
    try:
        yield from make(batches)
    finally:
        give_back()


def lean(make):
    """make for mapInArrow, whose worker holds only what it uses when a task is over.

    Workers stay idle beside the executor's heap for a minute, several to a core.
    """
    return partial(_leanly, make=make)
