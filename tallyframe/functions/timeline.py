"""Speaker timelines: one text per bin, each character a speaker, ``-`` for silence."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.binding import let

# Spark ships the helpers to executors that do not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SILENCE = "-"


_SEGMENTS = "array<array<struct<s:int,e:int>>>"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def speakers(timeline: Column) -> Column:
    """Distinct characters of the bins that are not silence."""
    spoken = F.filter(timeline, lambda b: b != SILENCE)
    return F.array_sort(F.array_distinct(_characters(F.array_join(spoken, ""))))


def segments(timeline: Column) -> Column:
    """Segments per speaker, in bins: a speaker's adjoining bins form one segment.

    A bin that names a speaker twice opens a second segment; such timelines take
    the slower path that follows the bins one by one.
    """
    twice = F.exists(
        timeline,
        lambda b: (F.char_length(b) > 1) & (F.size(F.array_distinct(_characters(b))) < F.char_length(b)),
    )
    return F.when(twice, _segments_one_by_one(timeline)).otherwise(_segments_by_edges(timeline)).cast(_SEGMENTS)


def _segments_by_edges(timeline: Column) -> Column:
    def of(who: Column) -> Column:
        bins = F.filter(
            F.transform(timeline, lambda b, i: F.when((b != SILENCE) & F.contains(b, who), i.cast("int"))),
            lambda i: i.isNotNull(),
        )
        return let(
            bins,
            lambda here: let(
                F.transform(here, lambda i: i + 1),
                lambda after: F.zip_with(
                    F.array_except(here, after),
                    F.array_except(after, here),
                    lambda s, e: F.struct(s.alias("s"), e.alias("e")),
                ),
            ),
        )

    return F.transform(speakers(timeline), of)


def _segments_one_by_one(timeline: Column) -> Column:
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def extend(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["s"].alias("s"), (i + 1).alias("e"))
        fresh = F.struct(i.alias("s"), (i + 1).alias("e"))
        return F.when(
            F.coalesce(last["e"] == i, F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)),
        ).otherwise(F.concat(acc, F.array(fresh)))

    def of(who: Column) -> Column:
        bins = F.flatten(
            F.transform(
                timeline,
                lambda b, i: F.when(
                    b != SILENCE,
                    F.transform(F.filter(_characters(b), lambda c: c == who), lambda _: i.cast("int")),
                ).otherwise(F.array().cast("array<int>")),
            )
        )
        return F.aggregate(bins, empty, extend)

    return F.transform(speakers(timeline), of)


def _overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + term(v))


def total_length(flat: Column) -> Column:
    return _sum(flat, lambda s: s["e"] - s["s"])


def uncovered(flat: Column, others: Column) -> Column:
    """Length of each segment beyond the overlaps with all segments of the other side, summed."""
    return _sum(
        flat,
        lambda s: F.greatest(F.lit(0), s["e"] - s["s"] - _sum(others, lambda o: _overlap(s, o))),
    )


def overlap_matrix(rows: Column, columns: Column) -> Column:
    """Shared length of every pair of speakers."""
    return F.transform(
        rows,
        lambda r: F.transform(columns, lambda c: _sum(r, lambda a: _sum(c, lambda b: _overlap(a, b)))),
    )


#: Up to so many speakers on the smaller side, the best assignment follows sets of speakers of a whole batch at once.
FEW = 8
LENGTHS = T.StructType([T.StructField(n, T.LongType()) for n in ("ref", "hyp", "fa", "ms")] + [T.StructField("ok", T.DoubleType())])


def _bits(text: str) -> dict[str, int] | None:
    """The bins of each speaker as bits; None where a bin names one twice or holds more than ASCII letters."""
    found: dict[str, int] = {}
    bit = 1
    for letters in text.split(","):
        if letters != SILENCE:
            for who in letters:
                known = found.get(who, 0)
                if known & bit:
                    return None
                found[who] = known | bit
        bit <<= 1
    names = "".join(found)
    return found if not names or (names.isascii() and names.isalpha()) else None


def _beyond(ours: list[int], theirs: list[int]) -> int:
    """``uncovered`` of speakers given as bits."""
    total = 0
    for rest in ours:
        while rest:
            # The lowest run of bits is the next segment.
            run = rest & ~(rest + (rest & -rest))
            rest ^= run
            total += max(0, run.bit_count() - sum((run & o).bit_count() for o in theirs))
    return total


def lengths(gt: Column, pred: Column) -> Column:
    """Speech of both sides, false alarms, missed speech and best assigned overlap of two timelines.

    Timelines of plain letters are compared as bits, a batch of rows at a time; NULL for all others.
    """

    def over_batch(gts: pd.Series, preds: pd.Series) -> pd.DataFrame:
        places, rows, matrices = [], [], []
        for i, (g, p) in enumerate(zip(gts, preds)):
            sides = [None if t is None else _bits(t) for t in (g, p)]
            if None in sides:
                continue
            ours, theirs = (list(s.values()) for s in sides)
            places.append(i)
            rows.append((sum(o.bit_count() for o in ours), sum(t.bit_count() for t in theirs), _beyond(theirs, ours), _beyond(ours, theirs)))
            few, many = sorted((ours, theirs), key=len)
            matrices.append([[(a & b).bit_count() for a in few] for b in many])
        out = pd.DataFrame(rows, columns=["ref", "hyp", "fa", "ms"], index=gts.index[places], dtype="Int64")
        out["ok"] = _assigned(matrices)
        return out.reindex(gts.index)

    return F.pandas_udf(over_batch, LENGTHS)(*[F.array_join(t, ",", "?") for t in (gt, pred)])


def _assigned(matrices: list[list[list[int]]]) -> np.ndarray:
    """``best_assignment`` of matrices with no more columns than rows."""
    out = np.zeros(len(matrices))
    width = np.array([len(m[0]) if m else 0 for m in matrices], dtype=int)
    for w in np.unique(width[(width > 0) & (width <= FEW)]):
        at = np.flatnonzero(width == w)
        cells = np.zeros((max(len(matrices[i]) for i in at), w, len(at)))
        for n, i in enumerate(at):
            cells[: len(matrices[i]), :, n] = matrices[i]
        best = np.zeros((1 << w, len(at)))
        for row in cells:
            before = best.copy()
            for taken in range(1, 1 << w):
                for c in range(w):
                    if taken >> c & 1:
                        np.maximum(best[taken], before[taken ^ 1 << c] + row[c], out=best[taken])
        out[at] = best[-1]
    for i in np.flatnonzero(width > FEW):
        out[i] = _solve(matrices[i])
    return out


def _solve(cells) -> float:
    """Shortest augmenting paths over one matrix."""
    gain = np.array([np.asarray(r, dtype=float) for r in cells])
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    cost = gain.max() - gain
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, dtype=int)
    for row in range(1, rows + 1):
        owner[0], col = row, 0
        best = np.full(cols + 1, np.inf)
        came, seen = np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while owner[col]:
            seen[col] = True
            slack = cost[owner[col] - 1] - row_price[owner[col]] - col_price[1:]
            closer = ~seen[1:] & (slack < best[1:])
            best[1:][closer], came[1:][closer] = slack[closer], col
            nxt = int(np.argmin(np.where(seen, np.inf, best)))
            step = best[nxt]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            best[~seen] -= step
            col = nxt
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    return float(sum(gain[owner[j] - 1, j - 1] for j in range(1, cols + 1) if owner[j]))


def best_assignment(matrix: Column) -> Column:
    """Largest total of a matrix when every row and column is used at most once.

    One row or one column needs only a maximum; larger matrices go through the
    shortest augmenting path method, one small matrix per row of data.
    """

    def over_batch(matrices: pd.Series) -> pd.Series:
        return matrices.map(lambda cells: None if cells is None else _solve(cells))

    flat = F.flatten(matrix)
    thin = (F.size(matrix) <= 1) | (F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0)) <= 1)
    solved = F.pandas_udf(over_batch, T.DoubleType())(F.when(~thin, matrix))
    return F.when(thin, F.coalesce(F.array_max(flat).cast("double"), F.lit(0.0))).otherwise(solved)
