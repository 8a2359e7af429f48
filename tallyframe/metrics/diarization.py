"""Diarisation error. ``pairs`` holds timelines ``gt`` and ``pred``.

A timeline belongs to one row, so segments, overlaps and the speaker mapping
are worked out inside the row; the only shuffle is the final aggregation.
Timelines of plain letters are compared as bits, a batch of rows at a time; any
other timeline takes the path that follows its segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import timeline as tl
from tallyframe.functions.binding import once
from tallyframe.metrics.common import to_long

PARTS = ["der", "missed_speech", "false_alarm", "speaker_confusion"]


def der_columns(pairs: DataFrame) -> DataFrame:
    """Add the four error rates per row; NULL when the reference has no speech."""
    rows = once(pairs.withColumn("__bits", tl.lengths(F.col("gt"), F.col("pred"))))
    plain = F.col("__bits.ref").isNotNull()
    for side in ("gt", "pred"):
        rows = rows.withColumn(f"__{side}_seg", tl.segments(F.when(~plain, F.col(side))))
        rows = rows.withColumn(f"__{side}_all", F.flatten(f"__{side}_seg"))
    rows = rows.withColumn("__matrix", tl.overlap_matrix(F.col("__gt_seg"), F.col("__pred_seg")))
    slow = {
        "ref": tl.total_length(F.col("__gt_all")),
        "hyp": tl.total_length(F.col("__pred_all")),
        "fa": tl.uncovered(F.col("__pred_all"), F.col("__gt_all")),
        "ms": tl.uncovered(F.col("__gt_all"), F.col("__pred_all")),
        "ok": tl.best_assignment(F.col("__matrix")),
    }
    rows = rows.withColumns({f"__{n}": F.when(plain, F.col(f"__bits.{n}")).otherwise(c) for n, c in slow.items()})
    confusion = F.greatest(F.lit(0.0), F.col("__hyp") - F.col("__fa") - F.col("__ok"))
    speech = F.when(F.col("__ref") > 0, F.col("__ref"))
    parts = {
        "missed_speech": F.col("__ms") / speech,
        "false_alarm": F.col("__fa") / speech,
        "speaker_confusion": confusion / speech,
        "der": (F.col("__ms") + F.col("__fa") + confusion) / speech,
    }
    return rows.withColumns(parts).select(*pairs.columns, *PARTS)


def diarization_error(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean error rates; rows without reference speech add nothing but stay in the denominator.

    Only the overall rate is undefined on such rows: their parts are zero. A row
    costs more to score than to move, so the rows are first spread evenly.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = der_columns(pairs.select(*by, "gt", "pred").repartition(tasks))
    wide = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in PARTS]
    )
    return to_long(wide, by, {p: F.col(p) / F.col("n") for p in PARTS}, F.col("n"))
