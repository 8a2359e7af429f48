"""Ordered scans that stay distributed when one key holds a large share of the rows.

A plain window sends every row of a key to one task. Here the keys above
``max_rows`` are cut into ranges of the order value; the window runs inside each
range, and the total of the earlier ranges is added afterwards. When no key is
that large, the plan is the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a single task may take; ``spark.tallyframe.maxRowsPerKey`` overrides it.
MAX_ROWS = 2_000_000
MAX_RANGES = 20_000
# Rows looked at for each range border.
SAMPLED = 16

_LOCAL = {"sum": F.sum, "min": F.min, "max": F.max}


def row_limit(df: DataFrame, max_rows: int | None) -> int:
    return max_rows or int(df.sparkSession.conf.get("spark.tallyframe.maxRowsPerKey", str(MAX_ROWS)))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition that also matches NULL keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def hot_keys(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or None.

    There are at most ``total / max_rows`` of them, so the result is small
    enough to keep on the driver and to broadcast.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > max_rows)
    rows = counted.collect()
    return df.sparkSession.createDataFrame(rows, counted.schema) if rows else None


def cut_ranges(
    df: DataFrame, keys: list[str], order_values: list[Column], max_rows: int
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``__part``: 0 for ordinary keys, a range number that rises with the order for hot ones.

    Ranges are cut at values that rows of the hot keys have: all order values
    together, so rows stay in one range only if they agree in every one.
    Returns the table and the hot keys, or None for them when there are none.
    """
    hot = hot_keys(df, keys, max_rows)
    if hot is None:
        return df.withColumn("__part", F.lit(0).cast("long")), None
    ranges = min(MAX_RANGES, 2 * -(-hot.agg(F.sum("__n")).first()[0] // max_rows))
    at = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(order_values)])
    valued = df.withColumn("__at", at)
    inside = valued.join(F.broadcast(hot), same_keys(valued, hot, keys), "left_semi") if keys else valued
    # An even sample, the same on every run: the rows with the least hashes.
    sampled = inside.select("__at").orderBy(F.xxhash64("__at"), "__at").limit(SAMPLED * ranges)
    sampled = sampled.agg(F.array_sort(F.collect_list("__at")).alias("all"))
    every = F.filter("all", lambda c, i: i % SAMPLED == SAMPLED - 1)
    cuts = sampled.select(F.array_distinct(every).alias("__cuts"))
    steps = F.array(*[F.lit(1 << i) for i in range(MAX_RANGES.bit_length(), -1, -1)])
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda n, step: n + F.when(F.get("__cuts", n + step - 1) <= F.col("__at"), step).otherwise(0),
    )
    # One row of at most MAX_RANGES values.
    marked = valued.crossJoin(F.broadcast(cuts))
    part = (below + 1).cast("long")
    if keys:
        flags = hot.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
        match = reduce(
            lambda a, b: a & b, [marked[k].eqNullSafe(flags[f"__k{i}"]) for i, k in enumerate(keys)]
        )
        marked = marked.join(F.broadcast(flags), match, "left")
    else:
        marked = marked.withColumn("__hot", F.lit(True))
    marked = marked.withColumn("__part", F.when(F.col("__hot"), part).otherwise(F.lit(0)))
    return marked.select(*df.columns, "__part"), hot


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    order_value: Column | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Inclusive running ``sum`` / ``min`` / ``max`` per key, in the given order.

    ``order`` must be unique per key for a reproducible result. ``order_value``
    is a value that never falls along ``order``; without it all order columns
    are used.
    """
    values = [order_value] if order_value is not None else [F.col(c) for c in order]
    parted, hot = cut_ranges(df, keys, values, row_limit(df, max_rows))
    direction = [F.desc(c) if reverse else F.asc(c) for c in order]
    group = [F.col(k) for k in keys]
    local = (
        Window.partitionBy(*group, F.col("__part"))
        .orderBy(*direction)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    if hot is None and keys:
        local = Window.partitionBy(*group).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    scanned = parted.withColumns({out: _LOCAL[op](expr).over(local) for out, (op, expr) in columns.items()})
    if hot is None:
        return scanned.drop("__part")
    totals = (
        parted.where("__part > 0")
        .groupBy(*keys, "__part")
        .agg(*[_LOCAL[op](expr).alias(f"__t_{out}") for out, (op, expr) in columns.items()])
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy(F.desc("__part") if reverse else F.asc("__part"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__part").alias("__p"),
        *[_LOCAL[op](f"__t_{out}").over(earlier).alias(f"__c_{out}") for out, (op, _) in columns.items()],
    )
    match = reduce(
        lambda a, b: a & b,
        [scanned[k].eqNullSafe(carried[f"__k{i}"]) for i, k in enumerate(keys)],
        scanned["__part"] == carried["__p"],
    )
    joined = scanned.join(carried, match, "left")
    for out, (op, _) in columns.items():
        before, here = F.col(f"__c_{out}"), F.col(out)
        whole = {
            "sum": F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here),
            "min": F.least(before, here),
            "max": F.greatest(before, here),
        }[op]
        joined = joined.withColumn(out, whole)
    return joined.drop(
        "__part", "__p", *[f"__k{i}" for i in range(len(keys))], *[f"__c_{out}" for out in columns]
    )


def row_index(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "frame",
    *,
    order_value: Column | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 0 in the given order."""
    scanned = ordered_scan(
        df, keys, order, {out: ("sum", F.lit(1).cast("long"))}, order_value=order_value, max_rows=max_rows
    )
    return scanned.withColumn(out, F.col(out) - 1)


def hash_order(seed: int | str, *columns: str) -> Column:
    """A reproducible random order key: md5 over the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_value(digest: Column) -> Column:
    """The leading 52 bits of an md5 text as a number that rises with the text."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
