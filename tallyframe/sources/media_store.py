"""A store of media by content that grows with every delivery.

The store is Parquet by the first two digits of the md5 ``digest``. A delivery
is compared with it by digests alone; the bytes that move are those of the rows
chosen to be stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import staged

#: Bits of the map of chosen rows: sixteen a row, at most 2**30, which are 128 MB to broadcast.
BITS_PER_ROW, MOST_BITS = 16, 1 << 30
#: Media that one task writes, about.
TASK_BYTES = 256 << 20
SHARDS = 256
NO_STORE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


@dataclass(frozen=True)
class Delivery:
    """The delivered rows with ``digest`` in place of their media, and the digests that were new, with their ``bytes``."""

    rows: DataFrame
    new: DataFrame


def stored_blobs(spark: SparkSession, root: str, content: str = "content") -> DataFrame:
    """``digest`` and the media of a store; empty where nothing has been stored yet."""
    try:
        return spark.read.parquet(root).select("digest", content)
    except AnalysisException as error:
        if error.getCondition() not in NO_STORE:
            raise
        return spark.createDataFrame([], f"digest string, `{content}` binary")


def _place(n_bits: int) -> tuple[Column, Column]:
    """Part of the map and bit in it for a row chosen by its digest and key."""
    bit = F.pmod(F.xxhash64("digest", "__key"), F.lit(n_bits)) + 1
    return F.bitmap_bucket_number(bit).alias("__part"), F.bitmap_bit_position(bit).alias("__bit")


def _only_chosen(rows: DataFrame, chosen: DataFrame, n_chosen: int) -> DataFrame:
    """Rows (digest, __key, media) that are ``chosen``. A broadcast map of bits leaves few others to the join."""
    n_bits = min(MOST_BITS, 1 << max(15, (BITS_PER_ROW * n_chosen).bit_length()))
    part, bit = _place(n_bits)
    bits = chosen.select(part, bit).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    placed = rows.withColumns({"__part": part, "__bit": bit}).join(F.broadcast(bits), "__part")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("__bit") % 8).cast("int"))) != 0
    # Not a semi join, which would be done before the one with the map; a digest is chosen once.
    return placed.where(marked).drop("__part", "__bit", "__bits").join(chosen, ["digest", "__key"])


def append_blobs(df: DataFrame, root: str, key: str, content: str = "content") -> Delivery:
    """Store the contents that ``root`` lacks, without rewriting what it holds.

    Of equal contents the row with the least ``key`` is stored, a null key
    after all others. Rows without media have a null digest and store nothing;
    empty media are a content. A delivery that is repeated, or repeated after a
    failure, writes nothing again. Deliveries to one store follow each other.
    """
    spark = df.sparkSession
    marked = df.withColumn("digest", F.md5(content))
    given = marked.where("digest IS NOT NULL").withColumn("__key", F.coalesce(F.concat(F.lit("0"), F.col(key).cast("string")), F.lit("1")))
    first = given.groupBy("digest").agg(F.min("__key").alias("__key"), F.max(F.octet_length(content)).cast("long").alias("bytes"))
    chosen = staged(first.join(stored_blobs(spark, root, content).select("digest"), "digest", "left_anti"), [])
    n_chosen, size = chosen.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n_chosen:
        rows = _only_chosen(given.select("digest", "__key", content), chosen.select("digest", "__key"), n_chosen)
        # A task writes one shard, or a part of one where that is much.
        slices = -(-size // (SHARDS * TASK_BYTES)) or 1
        at = {"shard": F.substring("digest", 1, 2), "__slice": F.pmod(F.xxhash64("digest"), F.lit(slices))}
        spread = rows.select("digest", content).withColumns(at).repartition("shard", "__slice")
        # Rows may share a key.
        blobs = spread.dropDuplicates(["shard", "__slice", "digest"]).drop("__slice")
        blobs.write.mode("append").partitionBy("shard").parquet(root)
    return Delivery(marked.drop(content), chosen.select("digest", "bytes"))
