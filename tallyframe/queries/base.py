"""Registered queries: a Spark function and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.ordered import row_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def r6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)


def scores(df: DataFrame) -> DataFrame:
    """Metric rows ready to compare: six decimals, undefined as NULL."""
    return df.withColumn("value", F.when(~F.isnan("value"), r6(F.col("value")) + F.lit(0.0)))


def frames(t: Tables) -> DataFrame:
    """Events of a user as the frames of a clip, numbered by time."""
    events = t.events.withColumnRenamed("user_id", "clip")
    return row_index(events, ["clip"], ["ts", "event_id"])


FRAMES = (
    "frames AS (SELECT user_id AS clip, event_id, ts, event_type, value, props, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
)

TYPES = ["click", "error", "purchase", "signup", "view"]


def previous(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Attach columns of the frame before, by an equality join on (clip, frame)."""
    before = rows.select("clip", (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(before, ["clip", "frame"])


def unpivot(source: str, by: list[str], values: dict[str, str], n: str = "n") -> str:
    """SQL that turns one wide row per group into (metric, value, n_used) rows."""
    keys = "".join(f"{b}, " for b in by)
    parts = [
        f"SELECT {keys}'{m}' AS metric, round(CAST({v} AS DOUBLE), 6) + 0.0 AS value, "
        f"CAST({n} AS BIGINT) AS n_used FROM {source} WHERE ({v}) IS NOT NULL"
        for m, v in values.items()
    ]
    return " UNION ALL ".join(parts)
