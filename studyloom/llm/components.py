"""Connected components of links by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm._store import keep


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node and label (the smallest node reachable) for every node that has a link.

    Labels are tables from end to end: each round takes the least label among neighbours
    (pre-aggregated before the shuffle) and then that label's own label, so chains
    shorten by half or more. Each round is written to the shared folder.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        moved = keep(nearer.join(heads, "label").select("node", F.least("label", "head").alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
