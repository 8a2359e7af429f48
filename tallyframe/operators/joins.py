"""Joins that need more than an equality, and table unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ordered import hot_keys, ordered_scan, row_limit


def first_match(df: DataFrame, lookup: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join where the first lookup row per key wins; unmatched rows keep NULLs."""
    rest = [c for c in lookup.columns if c not in on]
    best = lookup.groupBy(*on).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("__first")
    )
    return df.join(best, on, "left").select(*df.columns, *[F.col(f"__first.{c}").alias(c) for c in rest])


def lookup_join(df: DataFrame, lookup: DataFrame, on: list[str], max_rows: int | None = None) -> DataFrame:
    """Inner join with a table of one row per key.

    Keys with more than ``max_rows`` rows are joined apart: their few lookup rows
    (one per hot key) are broadcast, so no such key gathers in one task.
    """
    hot = hot_keys(df, on, row_limit(df, max_rows))
    if hot is None:
        return df.join(lookup, on)
    keys = F.broadcast(hot.select(*on))
    few = F.broadcast(lookup.join(keys, on, "left_semi"))
    return df.join(few, on).unionByName(df.join(keys, on, "left_anti").join(lookup, on))


def present_in(df: DataFrame, listing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose file or key is listed."""
    return df.join(listing.select(*on), on, "left_semi")


def absent_from(df: DataFrame, listing: DataFrame, on: list[str]) -> DataFrame:
    return df.join(listing.select(*on), on, "left_anti")


def gather(df: DataFrame, keys: list[str], order: list[str], item: Column, out: str) -> DataFrame:
    """Collect the items of each key into one ordered array, one row per key.

    The array is the answer itself, so it must fit into a row; a larger one
    fails. Every input partition collects its own part before the shuffle.
    Where only a few items of a key are used, number the rows and join instead.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), item.alias("item"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["item"]).alias(out))


def asof_next(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    on: str,
    payload: list[str],
    right_order: list[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Attach the right row at or after ``on``; past the last one, the last row is used.

    Left rows whose key has no right row are dropped. Of several right rows at
    the same position the first in ``right_order`` counts.
    """
    marks = right.select(*keys, on).distinct()
    both = left.select(*keys, on).distinct().withColumn("__mark", F.lit(0)).unionByName(
        marks.withColumn("__mark", F.lit(1))
    )
    ahead = ordered_scan(
        both,
        keys,
        [on, "__mark"],
        {"__next": ("min", F.when(F.col("__mark") == 1, F.col(on)))},
        reverse=True,
        max_rows=max_rows,
    )
    last = marks.groupBy(*keys).agg(F.max(on).alias("__last"))
    target = (
        ahead.where("__mark = 0")
        .join(last, keys)
        .select(*keys, on, F.coalesce("__next", "__last").alias("matched"))
    )
    found = left.join(target, [*keys, on])
    renamed = right.select(*keys, F.col(on).alias("matched"), *payload, *[c for c in right_order if c not in payload])
    return first_match(found, renamed, [*keys, "matched"], right_order).select(*left.columns, "matched", *payload)


def align(predictions: DataFrame, truth: DataFrame, by: list[str], index: str = "row_idx") -> DataFrame:
    """Pair prediction i with truth row i of the same task; the shorter side sets the length."""
    return predictions.join(truth, [*by, index])


def union_tagged(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Union by name with missing columns as NULL and the table name in ``tag``."""
    result: DataFrame | None = None
    for name, table in tables.items():
        tagged = table.withColumn(tag, F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    if result is None:
        raise ValueError("nothing to merge")
    return result
