from __future__ import annotations

import zlib
from collections import defaultdict

import cases
import numpy as np
import pytest

from tallyframe.llm.sharding import hilbert_index, shard, text_bounds, write_shards


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 5), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_steps_of_one(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    index = hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_law_and_slots(spark):
    data = cases.rows()
    got = shard(cases.table(spark, data)).collect()
    assert len(got) == len(data)
    size = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == size
    slots, curve = defaultdict(list), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        curve[r.shard].append(r.curve)
    assert sorted(slots) == list(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(max(curve[i]) <= min(curve[i + 1]) for i in range(7))


def test_shards_prune_each_dimension(spark):
    docs = spark.range(4096).selectExpr("id as doc_id", "'x' as text", "id % 64 as a", "id div 64 as b")
    got = shard(docs, dimensions=("a", "b"), shards=16).toPandas()
    box = got.groupby("shard").agg({"a": ["min", "max"], "b": ["min", "max"]})
    area = (box["a"]["max"] - box["a"]["min"] + 1) * (box["b"]["max"] - box["b"]["min"] + 1)
    assert area.max() <= 2 * 256


def test_texts_with_a_common_beginning_part_the_shards(spark):
    docs = spark.range(4096).selectExpr("id as doc_id", "'x' as text", "format_string('https://www.source_%02d', id % 64) as a", "id div 64 as b")
    got = shard(docs, dimensions=("a", "b"), shards=16).toPandas()
    box = got.assign(a=got["a"].str[-2:].astype(int)).groupby("shard").agg({"a": ["min", "max"], "b": ["min", "max"]})
    area = (box["a"]["max"] - box["a"]["min"] + 1) * (box["b"]["max"] - box["b"]["min"] + 1)
    assert area.max() <= 2 * 256


def test_bounds_of_texts_against_sorting(spark):
    texts = [None, "", *["same"] * 40, *[f"www.é{i}" for i in range(30)], *["z\U0001f600", "z\uffff"] * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "m string").repartition(7)
    every = sorted(t.encode() for t in texts if t is not None)
    for cuts in (1, 2, 8, 256):
        want = sorted({every[-(-i * len(every) // cuts) - 1] for i in range(1, cuts)})
        assert [t.encode() for t in text_bounds(docs, "m", cuts)] == want


def test_few_and_no_rows(spark):
    assert [(r.shard, r.slot) for r in shard(cases.table(spark, cases.rows()[:1])).collect()] == [(0, 0)]
    assert shard(cases.table(spark, [])).count() == 0


def test_files(spark, tmp_path):
    data = [r for r in cases.rows() if r[0] is not None and r[0] != 9]
    docs = cases.table(spark, data)
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(data) and set(docs.columns) < set(back.columns)
    assert back.select("shard_").distinct().count() == 8
