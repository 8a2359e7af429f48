"""Whitening against fractions and a plain eigensolver; contour integration on spectra that are hard to part."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from tallyframe.llm.queries import QUERIES
from tallyframe.llm.whitening import Spectrum, components, intervals, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int, component int, `a.b` string, y long"


def plain(vectors: dict) -> tuple[int, dict, np.ndarray, dict]:
    """n, exact deviations, covariance and centred vectors, from lists of Python numbers."""
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in vectors.items()}
    listed = sorted(set(x.values()))
    n, d = len(listed), len(listed[0])
    sums = [sum(v[j] for v in listed) for j in range(d)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    centre = np.array([[float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in listed])
    centred = {i: np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)]) for i, v in x.items()}
    return n, deviation, centre.T @ centre / n, centred


def check(rows, vectors, k=16):
    n, deviation, v, centred = plain(vectors)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    got: dict = {}
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-10)
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    assert set(got) == set(vectors)
    for j in range(k):
        ours = np.array([got[i][j + 1] for i in vectors])
        theirs = np.array([centred[i] @ axes[:, j] for i in vectors]) / math.sqrt(e[j])
        sign = np.sign(ours @ theirs)
        assert np.abs(ours - sign * theirs).max() < 1e-7
    assert all(len(c) == k for c in got.values())


def test_against_plain_version(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 12)) * np.linspace(5, 0.2, 12)
    vectors = {i: [float(c) for c in base[i if i % 3 else 0]] for i in range(150)}  # a third are equal
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5)]
    data = [(i, v, 1, 2, "clash", 3) for i, v in [*vectors.items(), *bad]]
    rows = whitened_components(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    check(rows, vectors)


def test_null_and_repeated_ids_keep_their_rows(spark):
    data = [(None, [1.0, 2.0]), (None, [2.0, 1.0]), (5, [0.0, 5.0]), (5, [0.0, 5.0])]
    rows = whitened_components(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1), (5, 1), (5, 2), (5, 2)]


def test_no_spread_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitened_components(spark.createDataFrame([], schema)).collect() == []
    assert whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert {r.component for r in whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema)).collect()} == {1}


def test_large_numbers_stay_exact(spark):
    vectors = {i: [float(2**33 * ((i * 7) % 11)), float(i), 1e9] for i in range(40)}
    rows = whitened_components(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")).collect()
    n, deviation, _, _ = plain(vectors)
    assert {r.vec_id: (r.n, int(r.deviation)) for r in rows} == {i: (n, deviation[i]) for i in vectors}


@pytest.mark.parametrize("kind", ["even", "equal", "close", "steep", "low rank", "diagonal", "small"])
def test_contour_integration(kind):
    rng = np.random.default_rng(4)
    e = {
        "even": np.linspace(1, 64, 64), "equal": np.array([5.0] * 20 + [1.0] * 44), "close": 1 + np.arange(64) * 1e-10, "steep": 10.0 ** -np.arange(64),
        "low rank": np.array([3.0, 2.0, 1.0] + [0.0] * 61), "diagonal": np.arange(64.0), "small": np.array([2.0, 1.0]),
    }[kind]
    q = np.eye(len(e)) if kind == "diagonal" else np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
    a = (q * e) @ q.T
    values, vectors = components((a + a.T) / 2, 16)
    wanted = np.sort(e)[::-1][:16]
    wanted = wanted[wanted > 1e-12 * wanted[0]]
    assert len(values) >= min(len(wanted), 12)
    assert np.abs(values - np.sort(e)[::-1][: len(values)]).max() < 1e-12 * wanted[0] * len(e)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * wanted[0] * len(e)


def test_inertia_counts():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    e, spectrum = np.linalg.eigvalsh(a), Spectrum(a)
    assert [spectrum.below(s) for s in np.linspace(-20, 20, 101)] == [int((e < s).sum()) for s in np.linspace(-20, 20, 101)]
    parts = intervals(spectrum, 16)
    assert sum(c for _, _, c in parts) >= 16
    assert all(c == ((e > low) & (e < high)).sum() for low, high, c in parts)


def test_registered_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, DATA).collect()
    check(rows, {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()})
