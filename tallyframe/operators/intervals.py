"""Speech segments against windows and half-second bins."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.timeline import SILENCE
from tallyframe.operators.joins import lookup_join
from tallyframe.operators.windows import sliding_seconds


def segments_in_windows(
    segments: DataFrame, clips: DataFrame, size: int = 30, stride: int = 15
) -> DataFrame:
    """Clip segments (``clip, seq, start, end, speaker``) to every window they touch.

    The windows of a segment follow from its times, so the range join is an
    equality join with the clips and an explode of the touched windows only.
    """
    last = F.floor((F.floor("duration").cast("int") - size) / stride)
    first_touched = F.greatest(F.lit(0), F.floor((F.col("start") - size) / stride) + 1)
    last_touched = F.least(last, F.floor(F.col("end") / stride))
    placed = (
        lookup_join(segments, clips.select("clip", "duration"), ["clip"])
        .where((F.floor("duration") >= size) & (first_touched <= last_touched))
        .withColumn("win_start", F.explode(F.sequence(first_touched * stride, last_touched * stride, F.lit(stride))))
    )
    return (
        placed.withColumns(
            {
                "rel_start": F.greatest(F.col("start"), F.col("win_start").cast("double")) - F.col("win_start"),
                "rel_end": F.least(F.col("end"), F.col("win_start").cast("double") + size) - F.col("win_start"),
            }
        )
        .where("rel_end > rel_start")
        .select("clip", F.col("win_start").cast("int").alias("win_start"), "seq", "start", "speaker", "rel_start", "rel_end")
    )


# Spark ships the helpers to executors that do not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits used of each number; the bins of a window are spread over as many numbers as they need.
WORD = 60


def _active_bins(bin_sec: float, n_bins: int) -> list[Column]:
    """Bits of the bins that one segment covers by more than half, ``WORD`` bins per number.

    The covered bins of a segment are neighbours: only the first and the last
    touched bin can be covered too little.
    """
    start, end = F.col("rel_start"), F.col("rel_end")

    def covered(i: Column) -> Column:
        return F.least(end, (i + 1) * bin_sec) - F.greatest(start, i * bin_sec) > bin_sec / 2

    first = F.floor(start / bin_sec)
    last = F.least(F.lit(n_bins - 1), F.ceil(end / bin_sec) - 1)
    low = F.when(covered(first), first).otherwise(first + 1).cast("int")
    high = F.when(covered(last), last).otherwise(last - 1).cast("int")
    one = F.lit(1).cast("long")
    words = []
    for base in range(0, n_bins, WORD):
        a, b = F.greatest(low - base, F.lit(0)), F.least(high - base, F.lit(WORD - 1))
        bits = F.call_function("shiftleft", one, b + 1) - F.call_function("shiftleft", one, a)
        words.append(F.when(a <= b, bits).otherwise(F.lit(0).cast("long")))
    return words


def window_speakers(placed: DataFrame, bin_sec: float = 0.5, n_bins: int = 60) -> DataFrame:
    """Per window: its speakers by first appearance, each with the bits of their active bins.

    A speaker's segments are merged by a bitwise OR before the shuffle, so no row
    is made per bin and a window holds one entry per speaker.
    """
    words = _active_bins(bin_sec, n_bins)
    names = [f"b{i}" for i in range(len(words))]
    any_bits = [F.bit_count(F.bit_or(n)) for n in names]
    total = any_bits[0]
    for count in any_bits[1:]:
        total = total + count
    return (
        placed.groupBy("clip", "win_start", "speaker")
        .agg(F.min(F.struct("rel_start", "start", "seq")).alias("first"), *[F.bit_or(w).alias(n) for n, w in zip(names, words)])
        .groupBy("clip", "win_start")
        .agg(
            F.array_sort(F.collect_list(F.struct("first", "speaker", F.array(*names).alias("bits")))).alias("speakers"),
            total.alias("active_bins"),
        )
    )


def letter_of(rank: Column) -> Column:
    """A, B, C ... for ranks from 0; more than 26 speakers is an error."""
    return F.when(rank < 26, F.char(rank.cast("long") + 65)).otherwise(
        F.raise_error(F.lit("more speakers than letters in one window")).cast("string")
    )


def speaker_letters(placed: DataFrame) -> DataFrame:
    """Letters by first appearance in the window."""
    ranked = window_speakers(placed).select("clip", "win_start", F.posexplode("speakers").alias("rank", "s"))
    return ranked.select("clip", "win_start", F.col("s.speaker").alias("speaker"), letter_of(F.col("rank")).alias("letter"))


class _Names(dict):
    """The letters of a set of ranks given as bits."""

    def __missing__(self, ranks: int) -> str:
        self[ranks] = "".join(chr(65 + r) for r in range(26) if ranks >> r & 1) or SILENCE
        return self[ranks]


def _labels(bits: Column, n_bins: int) -> Column:
    """The letters active in each bin, from the bits of all speakers in one array, speaker by speaker."""
    per_speaker = -(-n_bins // WORD)

    def over_batch(given: pd.Series) -> pd.Series:
        names = _Names()
        sizes = given.map(len).to_numpy() // per_speaker
        heard = np.flatnonzero(sizes)
        labels = np.full(len(given), ",".join([SILENCE] * n_bins), dtype=object)
        if len(heard):
            words = np.concatenate([given.iloc[i] for i in heard]).astype(np.int64).reshape(-1, per_speaker)
            starts = np.concatenate([[0], np.cumsum(sizes[heard])[:-1]])
            ranks = np.arange(len(words)) - np.repeat(starts, sizes[heard])
            active = [words[:, i // WORD] >> i % WORD & 1 for i in range(n_bins)]
            sets = np.add.reduceat(np.stack(active, axis=1) << ranks[:, None], starts)
            labels[heard] = [",".join([names[s] for s in row]) for row in sets.tolist()]
        return pd.Series(labels, index=given.index)

    return F.split(F.pandas_udf(over_batch, T.StringType())(bits), ",")


def bin_timeline(
    segments: DataFrame,
    clips: DataFrame,
    size: int = 30,
    stride: int = 15,
    bin_sec: float = 0.5,
    min_bins: int = 6,
) -> DataFrame:
    """Timeline of each window: the letters active in each bin, ``-`` for silence.

    A speaker is active when one segment covers more than half of the bin.
    Windows with fewer than ``min_bins`` active bins are dropped. The number of
    speakers counts every speaker of the window, also those that fill no bin.
    """
    n_bins = int(size / bin_sec)
    spoken = window_speakers(segments_in_windows(segments, clips, size, stride), bin_sec, n_bins)
    if min_bins <= 0:
        # Silent windows count too, but only in clips that have any segment.
        heard = clips.join(segments.select("clip").distinct(), "clip", "left_semi")
        spoken = sliding_seconds(heard, "duration", size, stride).select("clip", "win_start").join(
            spoken, ["clip", "win_start"], "left"
        )
    rows = spoken.where(F.coalesce("active_bins", F.lit(0)) >= min_bins)
    none = F.array().cast("array<bigint>")
    count = F.coalesce(F.size("speakers"), F.lit(0))
    # Reading the letter of the last speaker fails where there are too many.
    bits = F.when(letter_of(count - 1).isNotNull(), F.coalesce(F.flatten("speakers.bits"), none))
    rows = rows.select("clip", "win_start", bits.alias("bits"), F.when(F.col("speakers").isNull(), 0).otherwise(count).alias("count"), "active_bins")
    return rows.select(
        "clip",
        "win_start",
        _labels(F.col("bits"), n_bins).alias("timeline"),
        F.col("count").cast("long").alias("num_speakers"),
        F.coalesce("active_bins", F.lit(0)).alias("active_bins"),
    )
