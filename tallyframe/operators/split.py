"""Dividing a table into train, validation and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordered import hash_order


def hash_split(
    df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42, out: str = "split", names=("train", "test")
) -> DataFrame:
    """Exact reproducible split of the distinct keys by md5 order.

    Instead of sorting the table, the digest of the last training key is looked
    up: digests are counted by their first four characters, and only the keys of
    the one bucket that holds the cut are ordered. The table itself is marked by
    comparing digests, without a shuffle.
    """
    digests = df.select(key).distinct().select(hash_order(seed, key).alias("h"))
    bucket = F.substring("h", 1, 4)
    counts = digests.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    # At most 65,536 buckets.
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = counts.withColumns(
        {"upto": F.sum("n").over(Window.orderBy("b")), "goal": F.floor(F.sum("n").over(whole) * F.lit(ratio))}
    )
    at = running.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal"))).select(
        "b", (F.col("goal") - F.col("upto") + F.col("n")).alias("k")
    )
    inside = digests.join(F.broadcast(at), bucket == F.col("b"))
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h")))
    cut = ranked.where("r = k").agg(F.max("h"))
    mine = F.coalesce(hash_order(seed, key) <= cut.scalar(), F.lit(False))
    return df.withColumn(out, F.when(mine, names[0]).otherwise(names[1]))


def borrow_last(train: DataFrame, val: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Move the last n train keys, in key order, to the validation keys."""
    borrowed = train.select(key).distinct().orderBy(F.desc(key)).limit(n)
    kept = train.select(key).distinct().join(borrowed, key, "left_anti")
    return (
        kept.withColumn("split", F.lit("train"))
        .unionByName(val.select(key).distinct().withColumn("split", F.lit("val")))
        .unionByName(borrowed.withColumn("split", F.lit("val")))
    )


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys present in every table."""
    shared = tables[0].select(key)
    for table in tables[1:]:
        shared = shared.intersect(table.select(key))
    return shared.distinct()


def split_filter(df: DataFrame, column: Column, names: dict[str, str], out: str = "split") -> DataFrame:
    """Rename split codes; rows of a split that is not listed (hidden labels) are dropped."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(out, F.try_element_at(table, column)).where(F.col(out).isNotNull())


def subject_split(df: DataFrame, subject: str, ranges: dict[str, tuple[int, int]], out: str = "split") -> DataFrame:
    """Assign rows by subject number ranges (both ends included); others are dropped."""
    name = F.lit(None).cast("string")
    for split, (low, high) in ranges.items():
        name = F.when(F.col(subject).between(low, high), split).otherwise(name)
    return df.withColumn(out, name).where(F.col(out).isNotNull())


