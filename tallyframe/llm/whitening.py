"""Whitening of embeddings by their leading principal components, found by FEAST contour integration.

1. Entries are put on a grid (64 steps to one), and the distinct vectors are the fit list. Its size and sums are exact
   integers; its covariance is summed from centred vectors, in part inside each task and again in a few groups.
2. The covariance matrix, whose size is the dimension's square whatever the number of rows, is worked on by the driver.
   Inertia counts (signs of the pivots of the shifted, tridiagonal matrix) say how many eigenvalues lie below any number;
   bisection by them finds gaps, at which the wanted end of the spectrum is cut into intervals of a few eigenvalues. In
   each interval a random block is projected by a contour integral around the interval, the quadrature of solutions of
   complex shifted systems; Rayleigh-Ritz on the projected block extracts the eigenpairs, and the block is projected again
   until every one that the inertia counts promise has a residual near rounding. So none is missed.
3. All rows are projected in batches. A last pass over the fit list measures how far the covariance of what comes out is
   from the identity.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry are left out, as are rows of another
length than the commonest (of equals the longest). Entries beyond 2**46 count as 2**46. Ids may be null or repeat; every
row gets its own rows. Components whose eigenvalue is zero up to rounding have no whitened value and are left out, so a
fit list of one vector, or an empty table, gives no rows. Other columns are not looked at. ``deviation`` is null in the
query where it does not fit a long; the operator's is a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import short_batches, staged

STEPS, LIMIT, COMPONENTS = 64, 2**46, 16
#: Groups in which the sums of all tasks meet before they come to the driver.
GROUPS = 32
#: Quadrature nodes on half a circle; eigenvalues that an interval is meant to hold; rounds of projection at most.
NODES, PER_INTERVAL, ROUNDS = 12, 4, 60


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def grid(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, y) of the usable rows: y = floor(64 * entry) for each entry."""
    entry = quoted(vector).cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(2.0**46)), F.lit(-(2.0**46))) * STEPS), F.lit(LIMIT)), F.lit(-LIMIT))
    usable = rows.where(quoted(vector).isNotNull() & (F.size(quoted(vector)) > 0) & finite).select(quoted(id_column).alias("id"), F.transform(entry, bounded).alias("y"))
    lengths = usable.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return usable.where(F.size("y") == (lengths.d if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow batch as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(vectors: DataFrame, start: Callable, add: Callable, pack: Callable, unpack: Callable):
    """The sum of ``add(state, matrix)`` over all rows: one state per task, few groups of them, then the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                state = state + add(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([pack(state)], pa.binary())], names=["g", "state"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for value in batch.column("state"):
                state = state + unpack(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([pack(state)], pa.binary())], names=["state"])

    states = vectors.mapInArrow(each, "g int, state binary").groupBy("g").applyInArrow(group, "state binary").collect()  # at most GROUPS rows
    return sum((unpack(bytes(s.state)) for s in states), start())


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums, as integers of any size."""

    def add(y: np.ndarray) -> np.ndarray:
        total = y.sum(axis=0) if len(y) < 2**16 else y.astype(object).sum(axis=0)  # 2**46 * 2**16 fits
        return np.array([len(y), *total.tolist()], object)

    start = lambda: np.array([0] * (d + 1), object)
    n, *sums = summed(vectors, start, add, lambda s: ",".join(map(str, s)).encode(), lambda b: np.array([int(v) for v in b.split(b",")], object))
    return n, sums


def scaled(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, exactly: as 64-bit numbers where that holds all, else as Python's."""
    top = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if top < 2**62:
        return y * np.int64(n) - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y - sums / n, rounded once or twice."""
    return scaled(y, n, sums).astype(np.float64) / n


def covariance(vectors: DataFrame, d: int, n: int, sums: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the vectors, or of their projections on the columns of ``weights``.

    A projection has mean zero but for rounding, so what is summed are products of centred values in both cases.
    """
    k = d if weights is None else weights.shape[1]

    def add(y: np.ndarray) -> np.ndarray:
        c = centred(y, n, sums)
        c = c if weights is None else c @ weights
        return c.T @ c

    total = summed(vectors, lambda: np.zeros((k, k)), add, lambda s: s.tobytes(), lambda b: np.frombuffer(b).reshape(k, k))
    return (total + total.T) / (2 * n)


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and squares of the off-diagonal of a similar tridiagonal matrix (Householder reflections)."""
    a, d = a.copy(), len(a)
    for i in range(d - 2):
        x = a[i + 1 :, i].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x / size
        a[i + 1 :, i:] -= 2 * np.outer(v, v @ a[i + 1 :, i:])
        a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ v, v)
    return np.diag(a).tolist(), (np.diag(a, -1) ** 2).tolist()


class Spectrum:
    """Inertia of a symmetric matrix minus a shift: how many eigenvalues lie below the shift."""

    def __init__(self, a: np.ndarray):
        self.size = float(np.abs(a).sum(axis=1).max(initial=0.0))
        self.diagonal, self.squares = tridiagonal(a)
        self.tiny = max(self.size, 1e-300) * 1e-32

    def below(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for a, b2 in zip(self.diagonal, [0.0, *self.squares], strict=True):
            pivot = a - shift - b2 / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot < 0
        return count

    def eigenvalue(self, rank: int) -> float:
        """The eigenvalue with so many below it, by bisection to a millionth of a millionth."""
        low, high = -self.size * 1.001, self.size * 1.001
        for _ in range(42):
            middle = (low + high) / 2
            if self.below(middle) <= rank:
                low = middle
            else:
                high = middle
        return (low + high) / 2


def intervals(spectrum: Spectrum, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that hold the k greatest eigenvalues, cut in gaps; highest first."""
    d = len(spectrum.diagonal)
    values = [spectrum.eigenvalue(d - 1 - i) for i in range(min(k + PER_INTERVAL, d))]
    least_gap = spectrum.size * 1e-9
    out, high, begin = [], values[0] + max(abs(values[0]), spectrum.size) * 0.01, 0
    while begin < k:
        # The widest gap after the next few values; a cluster without gaps goes on until one comes, or to its end.
        ends = [i for i in range(begin, len(values) - 1) if values[i] - values[i + 1] > least_gap]
        near = [i for i in ends if i < begin + PER_INTERVAL] or ends[:1]
        if near:
            last = max(near, key=lambda i: values[i] - values[i + 1])
            low = (values[last] + values[last + 1]) / 2
        else:
            low = -spectrum.size * 1.01  # all that is left
        count = spectrum.below(high) - spectrum.below(low)
        out.append((low, high, count))
        high, begin = low, begin + count
    return out


def contour(a: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block projected on the eigenspace of an interval: half a circle around it, by Gauss-Legendre quadrature."""
    centre, radius, out = (low + high) / 2, (high - low) / 2, np.zeros_like(block)
    for x, w in zip(*np.polynomial.legendre.leggauss(NODES), strict=True):
        turn = np.exp(0.5j * np.pi * (1 + x))
        shifted = (centre + radius * turn) * np.eye(len(a)) - a
        out += 0.5 * radius * w * (turn * np.linalg.solve(shifted, block.astype(complex))).real
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, residual: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues (falling) and unit eigenvectors in an interval that holds ``count`` of them."""
    d = len(a)
    block = np.random.default_rng(1).standard_normal((d, min(d, 2 * count + 4)))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(contour(a, low, high, block))[0]
        values, turns = np.linalg.eigh(basis.T @ a @ basis)
        block = basis @ turns
        error = np.linalg.norm(a @ block - block * values, axis=0)
        found = np.flatnonzero((values > low) & (values < high) & (error <= residual))
        if len(found) == count:
            found = found[::-1]
            return values[found], block[:, found]
    raise RuntimeError(f"of {count} eigenvalues between {low} and {high}, {len(found)} were found")


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, with their unit eigenvectors as columns; zeros are left out."""
    if not len(a) or not a.any():
        return np.zeros(0), np.zeros((len(a), 0))
    scale = float(np.abs(a).max())
    a = a / scale
    spectrum = Spectrum(a)
    residual = 8 * len(a) * np.finfo(float).eps * spectrum.size
    parts = [feast(a, low, high, count, residual) for low, high, count in intervals(spectrum, min(k, len(a)))]
    # Once more for all intervals together, so that vectors of different ones are orthogonal up to rounding as well.
    basis = np.linalg.qr(np.concatenate([v for _, v in parts], axis=1))[0]
    values, turns = np.linalg.eigh(basis.T @ a @ basis)
    values, vectors = values[::-1][:k], (basis @ turns)[:, ::-1][:, :k]
    real = values > 8 * len(a) * np.finfo(float).eps * spectrum.size
    return values[real] * scale, vectors[:, real]


class Whitening(NamedTuple):
    """A fitted whitening; ``weights`` take a centred vector to its whitened values."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on vectors (y), each distinct one once; None if there are none."""
    distinct = staged(vectors.select("y").distinct())
    first = distinct.first()
    if first is None:
        return None
    d = len(first.y)
    n, sums = exact_sums(distinct, d)
    spread = covariance(distinct, d, n, sums)
    values, axes = components(spread, k)
    weights = axes / np.sqrt(values)
    error = np.abs(covariance(distinct, d, n, sums, weights) - np.eye(len(values))).max(initial=0.0)
    return Whitening(n, sums, values, values / max(np.trace(spread), 1e-300), weights, float(error))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): of rows (id, y), the exact squared distance from the mean times n * n, and the values."""
    n, sums, weights = model.n, model.sums, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = scaled(matrix(batch.column(1)), n, sums)
            small = z.dtype != object and z.shape[1] * int(np.abs(z).max()) ** 2 < 2**63
            squares = (z * z if small else z.astype(object) ** 2).sum(axis=1)
            values = z.astype(np.float64) / n @ weights
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * values.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.float64()))
            deviation = pa.array([Decimal(v) for v in squares.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "y").mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def whitened_components(rows: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    short_batches(rows.sparkSession)
    usable = grid(rows, id_column, vector)
    model = fit(usable, k)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
        usable = usable.limit(0)
    each = whiten(usable, model).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array(F.lit(0.0))
    return each.select(
        F.col("id").alias(id_column), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "place").alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
