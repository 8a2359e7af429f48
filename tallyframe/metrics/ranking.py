"""Scores that rank rows. ``pairs`` holds ``gt`` (0/1) and ``score``.

Rows are first counted per distinct score with a map-side combine. The running
counts then use the ordered scan, so a group with very many distinct scores is
cut into score ranges instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.metrics.common import NAN, to_long
from tallyframe.operators.ordered import ordered_scan


def _by_score(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum(F.col("gt").cast("long")).alias("pos"), F.count("*").alias("n")
    )


def average_precision(
    pairs: DataFrame, by: list[str], name: str = "ap", max_rows: int | None = None
) -> DataFrame:
    """Sum of precision times recall gain over the distinct scores, highest first."""
    running = ordered_scan(
        _by_score(pairs, by),
        by,
        ["score"],
        {"cum_pos": ("sum", F.col("pos")), "cum_n": ("sum", F.col("n"))},
        reverse=True,
        max_rows=max_rows,
    )
    gain = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    wide = running.groupBy(*by).agg(
        F.when(F.sum("pos") > 0, gain / F.sum("pos")).otherwise(F.lit(NAN)).alias("v"), F.sum("n").alias("n")
    )
    return to_long(wide, by, {name: F.col("v")}, F.col("n"))


def roc_auc(pairs: DataFrame, by: list[str], name: str = "auc", max_rows: int | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; NaN with one class only."""
    scored = _by_score(pairs, by).withColumn("neg", F.col("n") - F.col("pos"))
    running = ordered_scan(scored, by, ["score"], {"cum_neg": ("sum", F.col("neg"))}, max_rows=max_rows)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    chances = F.sum("pos").cast("double") * F.sum("neg")
    wide = running.groupBy(*by).agg(
        F.when(chances > 0, wins / chances).otherwise(F.lit(NAN)).alias("v"), F.sum("n").alias("n")
    )
    return to_long(wide, by, {name: F.col("v")}, F.col("n"))
