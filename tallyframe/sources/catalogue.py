"""Built samples of all datasets as one partitioned table, read by status and chosen task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.writers import KEYS


def read_catalogue(
    spark: SparkSession,
    root: str,
    status: DataFrame | None = None,
    chosen: DataFrame | None = None,
    split: str | None = None,
) -> DataFrame:
    """The samples under ``root`` (``dataset=/task=/split=``), columns that a dataset lacks as NULL.

    ``status`` (dataset, status) keeps the datasets that are ``ok``, ``chosen``
    (dataset, task) one task of each. Both have a row per dataset or task and
    are broadcast; the partitions to read follow from them while the job runs,
    so files of other datasets and tasks are not opened. Datasets without a
    status, or without a chosen task, are left out, and chosen tasks without
    files add nothing; ``unbuilt`` tells which.
    """
    # Names that look like numbers stay texts.
    samples = spark.read.option("mergeSchema", "true").parquet(root).withColumns({k: F.col(k).cast("string") for k in KEYS})
    if split is not None:
        samples = samples.where(F.col("split") == split)
    wanted = None
    if chosen is not None:
        # The filter drops nothing that could match; it tells the optimizer that the small side is selective.
        wanted = chosen.where("task > ''").select("dataset", "task")
    if status is not None:
        good = status.where("status = 'ok'").select("dataset")
        wanted = good if wanted is None else wanted.join(good, "dataset", "left_semi")
    if wanted is not None:
        samples = samples.join(F.broadcast(wanted), wanted.columns, "left_semi")
    return samples


def unbuilt(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen (dataset, task) without a sample."""
    return chosen.select("dataset", "task").distinct().join(samples.select("dataset", "task").distinct(), ["dataset", "task"], "left_anti")
