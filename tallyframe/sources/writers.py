"""Writing samples, results and media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["dataset", "task", "split"]


def write_samples(df: DataFrame, root: str, max_rows_per_file: int = 20_000, mode: str = "error") -> None:
    """Parquet by dataset, task and split; no shuffle, files bounded by their number of rows."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file).partitionBy(*KEYS).parquet(root)


def write_results(documents: DataFrame, root: str, mode: str = "error") -> None:
    """JSON documents (``model, document``) under ``model=...``: one small row per model."""
    documents.select("model", F.col("document").alias("value")).write.mode(mode).partitionBy("model").text(root)


def blob_table(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Split media off: rows that keep the md5 ``digest``, and one stored copy per digest.

    Equal contents are merged inside each partition before the shuffle, so a
    content that fills a third of the table moves once per partition.
    """
    marked = df.withColumn("digest", F.md5(content))
    blobs = marked.select("digest", content).dropDuplicates(["digest"])
    return marked.drop(content), blobs


def write_blobs(df: DataFrame, root: str, content: str = "content", mode: str = "error") -> DataFrame:
    """Store each distinct content once and return the rows with its digest."""
    rows, blobs = blob_table(df, content)
    blobs.withColumn("shard", F.substring("digest", 1, 2)).write.mode(mode).partitionBy("shard").parquet(root)
    return rows


def drop_metadata(df: DataFrame, columns: list[str] = ("clip_id", "win_start")) -> DataFrame:
    """Remove the window columns before training."""
    return df.drop(*columns)
