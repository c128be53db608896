"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached from each node of links (a, b).

    Every round each node takes the smallest label among itself and its
    neighbours, and then the label of its label.  A long chain so shrinks to
    a part each round; stars, the usual case of copies, need two rounds.
    Each round is written to the shared folder.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "links",
    )
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        heard = both.join(of_b, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        # the node that is my label learns of my neighbours' labels too
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "near").alias("new"))
        told = lower.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hint"))
        better = lower.join(told, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("new", F.coalesce("hint", "new")).alias("label")
        )
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(
            better.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")),
            "labels",
        )
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
