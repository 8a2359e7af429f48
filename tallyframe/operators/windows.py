"""Windows over frames and seconds of stored clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.binding import let
from tallyframe.functions.geometry import half_even


def sliding_frames(
    df: DataFrame,
    clip: list[str],
    frame: str = "frame",
    size: int = 16,
    stride: int = 16,
    center: int = 8,
) -> DataFrame:
    """Keep the centre row of every full window and add its first frame as ``start``.

    Frames are numbered without gaps, so a window is full when its last frame
    exists. Only centre rows and last frames meet, on (clip, start): no clip,
    however long, gathers in one task.
    """
    start = F.col(frame) - center
    centers = df.where((start >= 0) & (start % stride == 0)).withColumn("start", start)
    last = F.col(frame) - (size - 1)
    full = df.where((last >= 0) & (last % stride == 0)).select(*clip, last.alias("start"))
    return centers.join(full, [*clip, "start"], "left_semi").select(*df.columns, "start")


def sliding_seconds(
    clips: DataFrame, duration: str = "duration", size: int = 30, stride: int = 15, out: str = "win_start"
) -> DataFrame:
    """One row per window of ``size`` seconds that fits into the whole seconds of the clip."""
    last = F.floor(F.col(duration)).cast("int") - size
    return clips.where(last >= 0).withColumn(out, F.explode(F.sequence(F.lit(0), last, F.lit(stride))))


def window_bounds(onset: Column, offset: Column, total: Column, buffer: int = 5, fps: int = 30) -> dict[str, Column]:
    """Padded frame range (1-based) and its seconds."""
    first = F.greatest(F.lit(1), onset - buffer)
    last = F.least(total, offset + buffer)
    return {
        "start_frame": first,
        "end_frame": last,
        "start_sec": (first - 1) / fps,
        "end_sec": last / fps,
    }


def sample_frames_with_anchor(onset: Column, apex: Column, offset: Column, n: int = 16) -> Column:
    """Up to n frame numbers of [onset, offset] that include the apex.

    Long ranges are sampled evenly; when the apex is missed it replaces the
    nearest sampled frame, the earlier one on a tie.
    """
    total = offset - onset + 1

    def evenly() -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda k: (onset + half_even(k * (total - 1) / (n - 1)).cast("int")).cast("int"),
        )

    def swap(even: Column) -> Column:
        gaps = F.transform(even, lambda i: F.abs(i - apex))
        nearest = let(gaps, lambda g: F.array_position(g, F.array_min(g)) - 1)
        return let(
            nearest,
            lambda at: F.array_sort(
                F.transform(even, lambda i, k: F.when(k == at, apex).otherwise(i).cast("int"))
            ),
        )

    sampled = let(
        evenly(), lambda even: F.when(F.array_contains(even, apex.cast("int")), even).otherwise(swap(even))
    )
    return F.when(
        total <= n,
        F.when(total > 0, F.sequence(onset.cast("int"), offset.cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
    ).otherwise(sampled)


def sweep_windows(
    df: DataFrame, clip: list[str], strides: list[int], frame: str = "frame", size: int = 16, center: int = 8
) -> DataFrame:
    """Centre rows of the windows of several strides at once, one row per stride that hits the frame."""
    start = F.col(frame) - center
    hits = F.filter(F.array(*[F.lit(s) for s in strides]), lambda s: start % s == 0)
    centers = df.where(start >= 0).withColumn("stride", F.explode(hits)).withColumn("start", start)
    full = df.where(F.col(frame) >= size - 1).select(*clip, (F.col(frame) - (size - 1)).alias("start"))
    return centers.join(full, [*clip, "start"], "left_semi").select(*df.columns, "stride")


def sweep_statistics(
    swept: DataFrame, clips: DataFrame, clip: list[str], label: str, value: str, k: int = 5
) -> DataFrame:
    """Windows before and after the cap per label and the removal of equal values, per stride.

    The cap keeps min(n, k) of each label, so counts replace ranking.
    """
    per_label = swept.groupBy("stride", *clip, label).agg(F.count("*").alias("__n"))
    capped = per_label.groupBy("stride").agg(
        F.sum("__n").alias("raw_windows"), F.sum(F.least("__n", F.lit(k))).alias("kept_capped")
    )
    distinct = swept.select("stride", *clip, value).distinct()
    distinct = distinct.groupBy("stride").agg(F.count("*").alias("kept_distinct"))
    n_clips = clips.select(*clip).distinct().agg(F.count("*")).scalar()
    return capped.join(distinct, "stride").withColumn("kept_per_clip", F.col("kept_capped") / n_clips)


def sweep_totals(
    swept: DataFrame, clip: list[str], label: str, value: str, split: str = "split", k: int = 5
) -> DataFrame:
    """Windows and kept windows per stride, split and way of thinning, with all their totals in the same aggregation.

    ``task`` is ``capped`` (at most k of each label in a clip) or ``distinct`` (each value once in a clip). Totals have NULL
    in the columns they add up over; ``level`` is their grouping id (0 for single cells, 7 for the total of all). The
    windows are counted per clip first, so the cube expands counts and not windows.
    """
    parts = []
    for task, key, kept in (("capped", label, F.least("n", F.lit(k))), ("distinct", value, F.lit(1))):
        counted = swept.groupBy("stride", split, *clip, key).agg(F.count("*").alias("n"))
        parts.append(counted.groupBy("stride", split).agg(F.sum("n").alias("n"), F.sum(kept).alias("k")).withColumn("task", F.lit(task)))
    cube = parts[0].unionByName(parts[1]).cube("stride", split, "task")
    return cube.agg(F.sum("n").alias("raw_windows"), F.sum("k").alias("kept"), F.grouping_id().cast("long").alias("level"))
