"""Operators against brute force, with hot keys and shuffled input."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import timeline as tl
from tallyframe.metrics.ranking import average_precision, roc_auc
from tallyframe.operators import joins, select, split, windows
from tallyframe.operators.ordered import ordered_scan, row_index


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one clip."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        clip = "hot" if i % 3 == 0 else f"c{rng.randrange(40)}"
        rows.append((clip, rng.randrange(5000), i, rng.randrange(100) / 100, rng.randrange(100) / 100, rng.choice("abc")))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "clip string, t int, id int, x double, y double, label string").repartition(7)


def groups(rows, key="clip", order=("t", "id")):
    out = {}
    for r in sorted(rows, key=lambda r: [r[o] for o in order]):
        out.setdefault(r[key], []).append(r)
    return out


@pytest.mark.parametrize("max_rows", [None, 20, 3])
def test_row_index(skewed, max_rows):
    got = row_index(skewed, ["clip"], ["t", "id"], max_rows=max_rows).collect()
    for rows in groups(got).values():
        assert [r.frame for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("max_rows", [None, 11])
def test_scan(skewed, reverse, max_rows):
    columns = {"s": ("sum", F.col("id")), "lo": ("min", F.when(F.col("label") == "a", F.col("t"))), "hi": ("max", F.col("x"))}
    got = ordered_scan(skewed, ["clip"], ["t", "id"], columns, reverse=reverse, max_rows=max_rows).collect()
    for rows in groups(got).values():
        rows = rows[::-1] if reverse else rows
        for i, r in enumerate(rows):
            seen = rows[: i + 1]
            assert r.s == sum(v.id for v in seen)
            assert r.lo == min((v.t for v in seen if v.label == "a"), default=None)
            assert r.hi == max(v.x for v in seen)


def test_scan_of_the_whole_table(skewed):
    got = row_index(skewed, [], ["t", "id"], max_rows=50).collect()
    assert sorted(r.frame for r in got) == list(range(900))


def test_frequent_order_values_are_cut_by_the_next_column(spark):
    from tallyframe.operators.ordered import cut_ranges

    rows = [("hot", i % 3, f"n{i:04d}") for i in range(600)] + [("cold", 1, "x")]
    df = spark.createDataFrame(rows, "clip string, t int, name string").repartition(5)
    parted, _ = cut_ranges(df, ["clip"], [F.col("t"), F.col("name")], 20)
    sizes = parted.where("clip = 'hot'").groupBy("__part").count()
    assert sizes.agg(F.max("count")).first()[0] < 60
    got = row_index(df, ["clip"], ["t", "name"], max_rows=20).where("clip = 'hot'").orderBy("frame").collect()
    assert [(r.t, r.name) for r in got] == sorted((t, n) for c, t, n in rows if c == "hot")
    assert [r.frame for r in got] == list(range(600))


def test_one_order_value_for_all_rows(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), F.lit(None).cast("int").alias("t"), "id")
    got = row_index(df, ["k"], ["t", "id"], max_rows=10).orderBy("id").collect()
    assert [r.frame for r in got] == list(range(50))


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(5)], "k string, t int")
    got = row_index(df, ["k"], ["t"], max_rows=4).collect()
    assert sorted(r.frame for r in got if r.k is None) == list(range(30))


@pytest.mark.parametrize("chunk", [1000, 10, 3])
def test_greedy_min_distance(skewed, chunk):
    kept = select.greedy_min_distance(skewed, ["clip"], ["t", "id"], ["x", "y"], 0.2, chunk=chunk).collect()
    want = set()
    for rows in groups(skewed.collect()).values():
        points = []
        for r in rows:
            if all(math.hypot(r.x - a, r.y - b) >= 0.2 for a, b in points):
                points.append((r.x, r.y))
                want.add(r.id)
    assert {r.id for r in kept} == want


def test_random_rows_of_block(spark, tmp_path):
    folder = str(tmp_path / "blocks")
    numbers = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    # Several row groups a file, and splits that hold a part of them.
    numbers.repartitionByRange(5, "id").write.option("parquet.block.size", 8192).option("parquet.page.size", 1024).parquet(folder)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        table = spark.read.parquet(folder)
        per_block = table.groupBy("_metadata.file_path", "_metadata.file_block_start").agg(F.collect_set("id").alias("ids")).collect()
        assert len(per_block) > 5
        drawn = set()
        for seed in range(6):
            rows = select.random_rows_of_block(table, ["id"], 7, seed)
            ids = [r.id for r in rows.collect()]
            block = [b for b in per_block if set(ids) <= set(b.ids)]
            assert len(block) == 1 and len(set(ids)) == len(ids) == 7
            assert ids == [r.id for r in select.random_rows_of_block(table, ["id"], 7, seed).collect()]
            drawn.add((block[0].file_path, block[0].file_block_start))
            every = select.random_rows_of_block(table, ["id"], 5001, seed).collect()
            assert {r.id for r in every} == set(block[0].ids)
        assert len(drawn) > 1
        # The listing of files is cut by the path, not only the rows.
        scan = select.random_rows_of_block(table, ["id"], 7)._jdf.queryExecution()
        leaves = scan.sparkPlan().collectLeaves()
        assert leaves.size() == 1 and leaves.head().selectedPartitions().totalNumberOfFiles() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert select.random_rows_of_block(table.where("id < 0"), ["id"]).count() == 0


@pytest.mark.parametrize("max_rows", [None, 15])
def test_asof_next(skewed, max_rows):
    left = skewed.select("clip", "t", "id")
    right = skewed.where("label = 'a'").select("clip", "t", "id", "x")
    got = joins.asof_next(left, right.withColumnRenamed("id", "rid"), ["clip"], "t", ["x"], ["rid"], max_rows).collect()
    marks = groups(right.collect())
    want = {}
    for r in left.collect():
        if r.clip in marks:
            later = [m for m in marks[r.clip] if m.t >= r.t]
            want[r.id] = later[0].t if later else marks[r.clip][-1].t
    assert {r.id: r.matched for r in got} == want


@pytest.mark.parametrize("max_rows", [None, 10])
def test_balanced_negatives(skewed, max_rows):
    pos, neg = skewed.where("label = 'a'"), skewed.where("label <> 'a'")
    got = groups(select.balance_negatives(pos, neg, ["clip"], ["id"], max_rows=max_rows).collect())
    n_neg = {k: len(v) for k, v in groups(neg.collect()).items()}
    for clip, rows in groups(pos.collect()).items():
        assert len(got.get(clip, [])) == min(len(rows), n_neg.get(clip, 0))


def test_gather_keeps_a_key_in_one_row(skewed):
    got = joins.gather(skewed, ["clip"], ["t", "id"], F.col("id"), "ids").collect()
    assert {r.clip: r.ids for r in got} == {k: [r.id for r in v] for k, v in groups(skewed.collect()).items()}
    assert len(got) == len(groups(skewed.collect()))


def test_texts_with_one_beginning_are_cut(spark):
    from tallyframe.operators.ordered import cut_ranges

    rows = [("hot", f"media/images/frame-{i:06d}.jpg") for i in range(1000)]
    df = spark.createDataFrame(rows, "clip string, path string").repartition(6)
    parted, _ = cut_ranges(df, ["clip"], [F.col("path")], 100)
    assert max(r["count"] for r in parted.groupBy("__part").count().collect()) < 200
    got = row_index(df, ["clip"], ["path"], max_rows=100).collect()
    assert all(r.frame == int(r.path[19:25]) for r in got)


def test_more_bins_than_bits(spark):
    from tallyframe.operators.intervals import bin_timeline

    segments = spark.createDataFrame([("c", 0, 0.0, 10.0, "x"), ("c", 1, 25.0, 31.0, "y"), ("c", 2, 58.0, 60.0, "x")], "clip string, seq int, start double, end double, speaker string")
    clips = spark.createDataFrame([("c", 60.0)], "clip string, duration double")
    (row,) = bin_timeline(segments, clips, size=60, stride=60).collect()
    want = ["A"] * 20 + ["-"] * 30 + ["B"] * 12 + ["-"] * 54 + ["A"] * 4
    assert row.timeline == want and row.active_bins == 36 and row.num_speakers == 2


def test_hash_split_is_exact_and_stable(skewed):
    once = {r.id: r.split for r in split.hash_split(skewed, "id", 0.8).collect()}
    again = {r.id: r.split for r in split.hash_split(skewed.repartition(3), "id", 0.8).collect()}
    assert once == again
    assert sum(v == "train" for v in once.values()) == int(900 * 0.8)
    none = split.hash_split(skewed.limit(1), "id", 0.5).collect()
    assert none[0].split == "test"


def test_sampling_is_bounded_per_key(skewed):
    got = groups(select.sample_n(skewed, ["clip"], ["id"], 5).collect())
    assert {k: len(v) for k, v in got.items()} == {k: min(5, len(v)) for k, v in groups(skewed.collect()).items()}


def test_hot_keys_are_limited_before_the_shuffle(skewed):
    plan = select.cap_per_label(skewed, ["clip"], "label", ["t", "id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("max_rows", [10**6, 25])
def test_lookup_join(skewed, max_rows):
    names = skewed.select("clip").distinct().withColumn("name", F.upper("clip")).where("clip <> 'c1'")
    got = joins.lookup_join(skewed, names, ["clip"], max_rows).collect()
    assert sorted((r.id, r.name) for r in got) == sorted(
        (r.id, r.clip.upper()) for r in skewed.collect() if r.clip != "c1"
    )


def test_vote_ties(spark):
    df = spark.createDataFrame([("k", "b", 0), ("k", "a", 1), ("k", "a", 2), ("k", "b", 3)], "k string, v string, i int")
    assert select.majority_label(df, ["k"], "v", seen="i").first().v == "b"
    assert select.majority_label(df, ["k"], "v", order=["a", "b"]).first().v == "a"


def test_windows(spark):
    df = spark.range(35).select(F.lit("c").alias("clip"), F.col("id").alias("frame"))
    assert [r.start for r in windows.sliding_frames(df, ["clip"]).orderBy("start").collect()] == [0, 16]
    assert [r.start for r in windows.sliding_frames(df, ["clip"], stride=4).orderBy("start").collect()] == [0, 4, 8, 12, 16]
    clips = spark.createDataFrame([("a", 29.9), ("b", 30.0), ("c", 60.9)], "clip string, duration double")
    got = windows.sliding_seconds(clips).collect()
    assert sorted((r.clip, r.win_start) for r in got) == [("b", 0), ("c", 0), ("c", 15), ("c", 30)]


def test_anchor_frames(spark):
    cases = [(1, 1, 5), (10, 33, 60), (1, 100, 100), (5, 6, 40)]
    df = spark.createDataFrame(cases, "a int, b int, c int")
    got = df.select(windows.sample_frames_with_anchor(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()
    for (first, apex, last), row in zip(cases, got):
        total = last - first + 1
        if total <= 16:
            assert row.f == list(range(first, last + 1))
            continue
        even = [first + round(k * (total - 1) / 15) for k in range(16)]
        assert len(row.f) == 16 and apex in row.f and row.f == sorted(row.f)
        assert len(set(even) - set(row.f)) <= 1


def test_ap_and_auc_with_hot_groups(spark):
    rng = random.Random(3)
    data = [("g", rng.randrange(2), rng.randrange(40) / 10) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, gt int, score double")
    pos = [s for _, y, s in data if y]
    neg = [s for _, y, s in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for cut in sorted({s for _, _, s in data}, reverse=True):
        hits = sum(p >= cut for p in pos)
        recall = hits / len(pos)
        ap += (recall - before) * hits / sum(s >= cut for _, _, s in data)
        before = recall
    for max_rows in (None, 6):
        assert roc_auc(df, ["g"], max_rows=max_rows).first().value == pytest.approx(auc)
        assert average_precision(df, ["g"], max_rows=max_rows).first().value == pytest.approx(ap)


def test_assignment_against_all_permutations(spark):
    rng = random.Random(5)
    matrices = [[[rng.randrange(30) for _ in range(c)] for _ in range(r)] for r in range(1, 6) for c in range(1, 6)] + [[]]
    df = spark.createDataFrame([(m,) for m in matrices], "m array<array<int>>")
    got = [r.v for r in df.select(tl.best_assignment(F.col("m")).alias("v")).collect()]

    def best(m):
        if not m:
            return 0
        m = m if len(m) <= len(m[0]) else [list(c) for c in zip(*m)]
        return max(sum(m[i][p[i]] for i in range(len(m))) for p in itertools.permutations(range(len(m[0])), len(m)))

    assert got == [best(m) for m in matrices]


def test_segments_follow_repeated_speakers(spark):
    df = spark.createDataFrame([(["AA", "AA", "-", "B"],), (["AB", "A", "", "A"],)], "t array<string>")
    got = [[[tuple(s) for s in who] for who in r.s] for r in df.select(tl.segments(F.col("t")).alias("s")).collect()]
    assert got[0] == [[(0, 1), (0, 2), (1, 2)], [(3, 4)]]
    assert got[1] == [[(0, 2), (3, 4)], [(0, 1)]]


def test_union_tagged(spark):
    merged = joins.union_tagged({"a": spark.range(2), "b": spark.range(1).withColumn("x", F.lit("y"))})
    assert sorted((r.dataset, r.x) for r in merged.collect()) == [("a", None), ("a", None), ("b", "y")]
    with pytest.raises(ValueError):
        joins.union_tagged({})
