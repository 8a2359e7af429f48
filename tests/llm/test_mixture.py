from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import cases
import pytest

from tallyframe.llm.mixture import mix, mixture


def filled(sizes: dict, weights: dict, cap: float, total: float) -> dict:
    """Water-filling round by round."""
    open_keys, target = set(sizes), {}
    while open_keys:
        left = total - sum(target.values())
        share = {k: left * weights[k] / sum(weights[j] for j in open_keys) for k in open_keys}
        full = {k for k in open_keys if share[k] > cap * sizes[k]}
        if not full:
            return target | share
        target |= {k: cap * sizes[k] for k in full}
        open_keys -= full
    return target


@pytest.mark.parametrize("cap", [3, 1, 1.5])
def test_against_plain_version(spark, cap):
    data = cases.rows()
    got = mixture(cases.table(spark, data), cap=cap).collect()
    size = defaultdict(int)
    for r in data:
        size[r[3]] += len(cases.words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = filled(size, {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}, cap, sum(size.values()))
    want = []
    for s in order:
        mine = [r for r in data if r[3] == s]
        mine.sort(key=lambda r: (hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), len(cases.words(r[1]))))
        whole = int(target[s] // size[s]) if size[s] else 0
        left = int(target[s] + 0.5) - whole * size[s]
        for r in mine:
            n = len(cases.words(r[1]))
            part = max(0, min(n, left))
            left -= part
            want.append((r[0], r[3], n, size[s], whole * n + part))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= math.ceil(cap) * r.size


def words_of(rows) -> dict:
    taken = defaultdict(int)
    for r in rows:
        taken[r.doc_id] += len(cases.words(r.text))
    return {k: v for k, v in taken.items() if v}


def test_rows_are_repeated_and_cut(spark):
    data = [*cases.rows(), (9, "another text under this id", "en", "hot", 1, None, None, None), (None, "two words", "en", "hot", 1, None, None, None)]
    plan = defaultdict(int)
    for r in mixture(cases.table(spark, data)).collect():
        plan[r.doc_id] += r.taken
    out = mix(cases.table(spark, data))
    assert out.columns == [f.name for f in cases.SCHEMA]
    rows = out.collect()
    assert words_of(rows) == {k: v for k, v in plan.items() if v}
    whole = defaultdict(list)
    for r in data:
        whole[r[0]].append(r[1] or "")
    assert all(any(t.startswith(r.text) for t in whole[r.doc_id]) for r in rows)


def test_ids_of_several_rows_meet_their_target(spark):
    data = [(1, "w " * 2, "en", "a", 0, None, None, None), (1, "v " * 50, "en", "a", 0, None, None, None), (2, "u " * 10, "en", "b", 0, None, None, None)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = words_of(mix(cases.table(spark, data), weights=weights, total=54.0).collect())
    assert got == {1: 27, 2: 27}


def sources(spark, sizes: list[int]):
    return cases.table(spark, [(i, "w " * n, "en", f"s{i:03d}", 0, None, None, None) for i, n in enumerate(sizes)])


def test_targets_just_below_whole_repetitions(spark):
    """Sources of 100 and 201 words: 200.67 of 201 wanted. Sources that are exactly 1, 2 and 3 times taken."""
    assert [r.taken for r in mixture(sources(spark, [100, 201])).orderBy("doc_id").collect()] == [100, 201]
    docs = sources(spark, [100, 100, 100])
    for n in (1, 2, 3):
        weights = spark.createDataFrame([("s000", float(n)), ("s001", 0.1), ("s002", 0.1)], "source string, weight double")
        taken = mixture(docs, weights=weights, total=n * 100 * (1 + 0.2 / n)).where("doc_id = 0").first().taken
        assert taken == n * 100


def test_many_small_sources_meet_their_targets(spark):
    rng = random.Random(5)
    for r in mixture(sources(spark, [rng.randrange(0, 60) for _ in range(200)])).collect():
        assert abs(r.taken - r.target) <= 0.5
        assert r.taken <= 3 * r.size


def test_own_weights(spark):
    data = cases.rows()
    weights = spark.createDataFrame([("hot", 1.0), (None, 3.0)], "source string, weight double")
    got = mixture(cases.table(spark, data), weights=weights, total=100.0).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken or 0
    assert (taken["hot"], taken[None]) == (25, 75)


def test_empty_table(spark):
    assert mixture(cases.table(spark, [])).count() == 0
    assert mix(cases.table(spark, [])).count() == 0
