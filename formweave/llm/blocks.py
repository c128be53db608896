"""A stated set of queries against all vectors, in blocks of both.

Vectors are dealt to shards of about `shard_rows` rows and queries to blocks
of about `block_rows`; a task gets one shard and one block.  Neither grows
with the data, their numbers do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import written

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
IS_QUERY = "vec_id % 100 = 0"


def vectors(embeddings: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>): usable vectors, one for each id.

    Null vectors, empty ones and those with null or non-finite components
    are left out, all-zero ones too unless `zero`.  Of rows that repeat an
    id the smallest vector counts.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    # a null component makes the test null: not usable
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(fine, F.lit(False)) & (F.size("v") > 0)
    if not zero:
        usable &= F.exists("v", lambda x: x != 0)
    rows = embeddings.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(usable).groupBy("vec_id").agg(F.min("v").alias("v"))


def best(vecs: DataFrame, kernel, order: list[Column], k: int, score_type: str, is_query: str = IS_QUERY,
         shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows of each query over what `kernel` finds in each shard.

    kernel(shard, queries): Arrow tables of vec_id, v to a table of query_id, vec_id, score.
    """
    vecs = written(vecs, "vectors")
    queries = vecs.filter(is_query)
    shards, blocks = -(-vecs.count() // shard_rows) or 1, -(-queries.count() // block_rows) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vecs.select(deal(shards, 1).alias("s"), "vec_id", "v").withColumn("b", every(blocks))
    right = queries.select(deal(blocks, 2).alias("b"), "vec_id", "v").withColumn("s", every(shards))
    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(
        kernel, f"query_id bigint, vec_id bigint, score {score_type}"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
