"""What every recipe shares: sample rows without media, media attached last.

A recipe returns ``dataset, task, split, sample_id, messages, media``; ``media``
is the path (or key) of the file a row needs.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyframe.functions.messages import build_messages
from tallyframe.operators.joins import present_in
from tallyframe.sources.writers import write_samples

EMPTY = "array<binary>"


def samples(
    rows: DataFrame,
    dataset: str,
    task: str,
    split: str | Column,
    sample_id: Column,
    system: str,
    user: Column | str,
    answer: Column,
    media: Column,
    *extra: str,
) -> DataFrame:
    split = split if isinstance(split, Column) else F.lit(split)
    return rows.select(
        F.lit(dataset).alias("dataset"),
        F.lit(task).alias("task"),
        split.alias("split"),
        sample_id.cast("string").alias("sample_id"),
        build_messages(system, user, answer).alias("messages"),
        media.alias("media"),
        *extra,
    )


class SkipCounts:
    """Rows that recipes leave out, by reason: observed while the samples are written, so nothing is read twice.

    Counts are there after the first action on the samples. A step that Spark leaves out because there is nothing to
    read counts 0.
    """

    #: Seconds to wait for the figures of an action that is over; they arrive on a thread of their own.
    PATIENCE = 10.0

    def __init__(self):
        self._steps: list[tuple[str, Observation, Observation | None]] = []

    def watch(self, rows: DataFrame, counted: Column) -> tuple[DataFrame, Observation]:
        seen = Observation(f"skips-{uuid.uuid4().hex}")
        return rows.observe(seen, F.coalesce(counted, F.lit(0)).alias("n")), seen

    def filtered(self, rows: DataFrame, ok: Column, reason: str) -> DataFrame:
        rows, out = self.watch(rows, F.count_if(~ok))
        self._steps.append((reason, out, None))
        return rows.where(ok)

    def narrowed(self, rows: DataFrame, step: Callable[[DataFrame], DataFrame], reason: str) -> DataFrame:
        rows, before = self.watch(rows, F.count(F.lit(1)))
        rows, after = self.watch(step(rows), F.count(F.lit(1)))
        self._steps.append((reason, before, after))
        return rows

    def counts(self) -> dict[str, int]:
        """Rows left out by reason, in the order of the steps."""
        deadline, out = time.monotonic() + self.PATIENCE, {}

        def figure(seen: Observation | None) -> int:
            if seen is None or seen._jo is None:
                return 0
            while not seen._jo.future().isCompleted() and time.monotonic() < deadline:
                time.sleep(0.02)
            row = seen._jo.getRow() if seen._jo.future().isCompleted() else None
            return int(row.getLong(0)) if row is not None and row.size() else 0

        for reason, first, second in self._steps:
            out[reason] = out.get(reason, 0) + figure(first) - figure(second)
        return out


_COUNTING: ContextVar[SkipCounts | None] = ContextVar("skips", default=None)


@contextmanager
def counting_skips() -> Iterator[SkipCounts]:
    """Recipes called inside count the rows they leave out; outside their plans have no counters."""
    skips = SkipCounts()
    token = _COUNTING.set(skips)
    try:
        yield skips
    finally:
        _COUNTING.reset(token)


def keep(rows: DataFrame, step: Column | Callable[[DataFrame], DataFrame], reason: str) -> DataFrame:
    """Rows that fulfil a condition (NULL does not), or what a step that never repeats a row leaves of them."""
    skips = _COUNTING.get()
    if isinstance(step, Column):
        ok = F.coalesce(step, F.lit(False))
        return rows.where(ok) if skips is None else skips.filtered(rows, ok, reason)
    return step(rows) if skips is None else skips.narrowed(rows, step, reason)


def write_counted(build: Callable[[], DataFrame], root: str, **options) -> dict[str, int]:
    """Write the samples of a recipe and return the rows it left out, by reason."""
    with counting_skips() as skips:
        made = build()
    write_samples(made, root, **options)
    return skips.counts()


def existing(rows: DataFrame, listing: DataFrame | None, media: Column, reason: str = "missing file") -> DataFrame:
    """Rows whose file is listed (``path``); all rows when there is no listing."""
    marked = rows.withColumn("__path", media)
    if listing is not None:
        listed = listing.withColumnRenamed("path", "__path")
        marked = keep(marked, lambda r: present_in(r, listed, ["__path"]), reason)
    return marked.drop("__path")


def attach(rows: DataFrame, media: DataFrame, kind: str, empty: list[str] = ()) -> DataFrame:
    """Add the ``images``, ``videos`` or ``audios`` of a sample table from ``path, content``."""
    joined = rows.join(media.select(F.col("path").alias("media"), "content"), "media")
    if kind == "images":
        item = F.struct(F.col("content").alias("bytes"), F.lit(None).cast("string").alias("path"))
    else:
        item = F.col("content")
    columns = {kind: F.array(item)}
    for name in empty:
        columns[name] = F.array().cast("array<struct<bytes:binary,path:string>>" if name == "images" else EMPTY)
    return joined.withColumns(columns).drop("content", "media")


def box_line(title: str, box: Column) -> Column:
    from tallyframe.functions.messages import box_text

    return F.concat(F.lit(title), box_text(box))
