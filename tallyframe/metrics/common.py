"""Shared shapes: every metric returns ``by..., metric, value, n_used``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where nothing over nothing is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def key_of(label: str) -> str:
    """Metric suffix of a class name."""
    return label.lower().replace("/", "_").replace(" ", "_")


def to_long(wide: DataFrame, by: list[str], values: dict[str, Column], n_used: Column) -> DataFrame:
    """One row per metric; metrics that are NULL for a group are left out."""
    cells = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    return (
        wide.select(*by, n_used.cast("long").alias("n_used"), F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .select(*by, "metric", "value", "n_used")
    )
