"""Loading the given tables and casting them to the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds since 1970, naive timestamps and dates being UTC whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the shape of usage events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"),
        "event_id",
        micros("ts").alias("ts_us"),
        F.col("event_type").alias("event"),
        F.col("props").alias("params_json"),
        F.lit(False).alias("once"),
        "value",
    )
