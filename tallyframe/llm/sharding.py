"""Sharding along a Hilbert curve, so that each shard covers a small box of several metadata dimensions.

Each dimension becomes a number of ``bits`` bits by its quantiles over all rows (whole texts in the order of
their bytes). The numbers are turned into one curve index, the rows are sorted by it over the whole cluster, and the
sorted sequence is cut into ``shards`` runs. Rows one after the other share most of their metadata, so a reader can skip whole files by min and max.

The law is ``rows``: shard sizes differ by one row at most. The sort is a range partition on (index, crc32 of the text,
id), so a value that a third of all rows share is cut between its rows, and equal texts with equal metadata stay
together. Positions are the row number within its range plus the number of rows in earlier ranges.

Defined cases: nulls of any dimension are its first value; a null text has no bytes (size 1, crc32 0); an empty table
gives no row; fewer rows than shards leave shards empty. Rows equal in all sort columns may swap places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.common import field, fresh, short_batches, staged

SHARDS, BITS = 8, 8
#: Accuracy of the quantiles: places in error are at most rows / ACCURACY.
ACCURACY = 10_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2**bits.

    Undoes, from the highest bit down, the reflections and turns of the sub-cubes, then reads the bits in Gray code.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    odd = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        odd ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= odd
    index = np.zeros(x.shape[1], dtype=np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return index.astype(np.int64)


def text_bounds(rows: DataFrame, name: str, cuts: int) -> list[str]:
    """At most cuts - 1 whole texts, in the order of their bytes, that part the rows evenly: counted, not sampled."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("p")))
    total, offsets = 0, []
    for p, n in sorted(ranged.groupBy("p").agg(F.sum("n").alias("n")).collect()):  # one number per range
        offsets.append((p, total))
        total += n
    if not total:
        return []
    starts = rows.sparkSession.createDataFrame(offsets, "p int, start long")
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    ranked = ranged.withColumn("upto", upto).join(F.broadcast(starts), "p").withColumn("upto", F.col("start") + F.col("upto"))
    share = lambda c: F.least(F.floor(c.cast("decimal(20,0)") * cuts / total), F.lit(cuts - 1))
    return sorted((r.v for r in ranked.where(share(F.col("upto")) > share(F.col("upto") - F.col("n"))).select("v").collect()), key=str.encode)


def quantised(rows: DataFrame, names: list[str], bits: int) -> list[Column]:
    """A column of whole numbers below 2**bits for each dimension, from quantiles over all rows; texts count as a whole."""
    cuts = 1 << bits
    texts = [n for n in names if isinstance(rows.schema[n].dataType, T.StringType)]
    numbers = {n: F.col(n).cast("double") for n in names if n not in texts}
    bounds = {n: text_bounds(rows, n, cuts) for n in texts}
    if numbers:
        shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
        found = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"q{i}") for i, c in enumerate(numbers.values())]).first()
        bounds |= {n: sorted(set(found[i] or [])) for i, n in enumerate(numbers)}
    return [place(numbers.get(n, F.col(n)), bounds[n], cuts) for n in names]


def place(value: Column, bounds: list[float] | list[str], cuts: int) -> Column:
    """How many bounds are not above the value; where bounds are few, spread over the whole range. Null: 0."""
    if not bounds:
        return F.lit(0).cast("long")
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value))
    if len(bounds) < cuts - 1:
        below = F.floor(below * F.lit((cuts - 1) / len(bounds)))
    return F.when(value.isNotNull(), below).otherwise(0).cast("long")


def with_index(rows: DataFrame, names: list[str], bits: int, out: str) -> DataFrame:
    short_batches(rows.sparkSession)
    kept = rows.columns
    numbers = [f"_d{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in numbers], axis=1)
            index = hilbert_index(points, bits) if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(index, pa.int64())], names=[*kept, out])

    places = quantised(rows, names, bits)
    wide = rows.select("*", *[p.alias(n) for p, n in zip(places, numbers, strict=True)])
    return wide.mapInArrow(run, T.StructType([*[field(rows, c) for c in kept], T.StructField(out, T.LongType())]))


def shard(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("lang", "source", "size"),
    shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """One row per document: id, the dimensions, size (bytes + 1), text_crc32, curve (index), shard, slot.

    ``size`` is a dimension that each table has; the others are columns of ``docs``.
    """
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    others = [d for d in dimensions if d != "size"]
    rows = docs.select(
        F.col(id_column).alias("id"), *[F.col(d).alias(f"m{i}") for i, d in enumerate(others)],
        (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
    )
    rows = staged(rows)
    named = {d: f"m{i}" for i, d in enumerate(others)} | {"size": "size"}
    curved = with_index(rows, [named[d] for d in dimensions], bits, "curve")
    order = ["curve", "text_crc32", "id"]
    ranged = curved.repartitionByRange(*order).sortWithinPartitions(*order)
    # The partition number is in the high bits of this number, the row number within it in the low 33.
    ranged = staged(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(ranged.groupBy(part.alias("p")).count().collect())
    total, offsets = 0, []
    for p, n in counts:  # one number per partition of the sort
        offsets.append((p, total))
        total += n
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets, "p long, start long")
    placed = ranged.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("position", F.col("start") + row)
    number = F.floor(F.col("position") * F.lit(shards) / F.lit(max(total, 1))).cast("int")
    exact = F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", exact if total < 2**59 else number)
    return placed.select(
        F.col("id").alias(id_column), *[F.col(named[d]).alias(d) for d in others], "size", "text_crc32", "curve", "shard",
        (F.col("position") - first).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, *, id_column: str = "doc_id", **options) -> None:
    """Write all rows of ``docs`` as Parquet below one folder per shard, each sorted along the curve. Ids must be unique."""
    key, number, slot = (fresh(docs, n) for n in ("_id", "shard", "slot"))
    where = shard(docs, id_column=id_column, **options)
    where = where.select(F.col(id_column).alias(key), F.col("shard").alias(number), F.col("slot").alias(slot))
    rows = docs.join(where, F.col(id_column).eqNullSafe(F.col(key))).drop(key)
    rows.repartitionByRange(number, slot).sortWithinPartitions(number, slot).drop(slot).write.partitionBy(number).parquet(path)
