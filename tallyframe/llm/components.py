"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label, so long chains
    shorten by jumps. All steps are joins and grouped minima; the only number that comes to the driver is how many
    labels changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.where("a <> b").distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        least = both.join(known, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(least, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root"))
        step = checkpoint(step)
        changed = step.where("old <> root").limit(1).count()
        labels = step.select("node", "root")
        if not changed:
            return labels
