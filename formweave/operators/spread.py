"""Dealing out rows that are dear to process, and keeping growing tables from being broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, dealt out by a hash of keys over as many tasks as the session shuffles to.

    In front of work that costs far more than sending its rows (a CV read by
    hundreds of patterns, a page parsed): files come as few large splits, and
    each would be one task.  Name a key and the content, so that rows without
    a key don't meet in one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def growing(rows: DataFrame) -> DataFrame:
    """The rows as a side that is sorted and merged, never broadcast.

    Sizes are guessed from compressed files, from one entry a map or array and
    from one row an unfolded one: profiles of a million candidates pass for a
    few MB, and would be built as one table in the driver.
    """
    return rows.hint("merge")
