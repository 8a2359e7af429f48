"""Media stores that grow, the catalogue of built samples, and truth tables that are missing."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyframe.plans.evaluate import evaluate
from tallyframe.sources import media_store as store
from tallyframe.sources.catalogue import read_catalogue, unbuilt
from tallyframe.sources.readers import load_truths
from tallyframe.sources.writers import write_samples


def media(spark, rows):
    return spark.createDataFrame(rows, "id long, note string, content binary")


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def held(spark, root):
    return sorted((r.digest, bytes(r.content)) for r in store.stored_blobs(spark, root).collect())


def test_store_grows_without_rewriting(spark, tmp_path):
    root = str(tmp_path / "media")
    assert store.stored_blobs(spark, root).count() == 0
    same = b"x" * 5000
    one = [(i, "a", same) for i in range(300)] + [(None, "b", same), (1000, "c", b""), (1001, "d", None), (7, "e", b"7"), (7, "f", b"7")]
    first = store.append_blobs(media(spark, one), root, "id")
    expected = sorted((hashlib.md5(c).hexdigest(), c) for c in (same, b"", b"7"))
    assert held(spark, root) == expected
    rows = first.rows.collect()
    assert first.rows.columns == ["id", "note", "digest"] and len(rows) == len(one)
    assert sorted((r.id or -1, r.note, r.digest or "") for r in rows) == sorted((i or -1, n, hashlib.md5(c).hexdigest() if c is not None else "") for i, n, c in one)
    assert sorted(r.bytes for r in first.new.collect()) == [0, 1, 5000]
    before = files(tmp_path / "media")
    # The same again writes nothing, more of it adds files and leaves those that are there.
    assert store.append_blobs(media(spark, one), root, "id").new.count() == 0
    assert files(tmp_path / "media") == before
    more = [(i, "g", f"{i % 400}".encode()) for i in range(2000)]
    second = store.append_blobs(media(spark, one + more), root, "id")
    assert second.new.count() == 399  # b"7" is there
    after = files(tmp_path / "media")
    assert {p: t for p, t in after.items() if p in before} == before and len(after) > len(before)
    assert held(spark, root) == sorted(expected + [(hashlib.md5(c).hexdigest(), c) for c in {m[2] for m in more} - {b"7"}])


def test_store_of_nothing(spark, tmp_path):
    root = str(tmp_path / "media")
    done = store.append_blobs(media(spark, [(1, None, None)]), root, "id")
    assert done.rows.collect()[0].digest is None and done.new.count() == 0 and held(spark, root) == []
    assert store.append_blobs(media(spark, []), root, "id").rows.count() == 0


def test_store_in_slices_with_a_full_map(spark, tmp_path, monkeypatch):
    """More bytes than a task may write, and a map so small that it lets nearly every row through."""
    monkeypatch.setattr(store, "TASK_BYTES", 1)
    monkeypatch.setattr(store, "MOST_BITS", 1 << 6)
    root = str(tmp_path / "media")
    rows = [(i % 500, "a", f"medium {i % 700}".encode()) for i in range(3000)]
    assert store.append_blobs(media(spark, rows), root, "id").new.count() == 700
    assert [c for _, c in held(spark, root)] == [c for _, c in sorted((hashlib.md5(m).hexdigest(), m) for m in {r[2] for r in rows})]


def test_catalogue_reads_chosen_partitions_only(spark, tmp_path):
    root = str(tmp_path / "samples")
    parts = [(d, t, s, i) for d in ("one", "two", "3") for t in ("a", "b") for s in ("train", "test") for i in range(4)]
    write_samples(spark.createDataFrame(parts, "dataset string, task string, split string, n long"), root)
    write_samples(spark.createDataFrame([("four", "a", "test", "word")], "dataset string, task string, split string, text string"), root, mode="append")
    status = spark.createDataFrame([("one", "ok"), ("two", "failed"), ("3", "ok"), ("four", "ok")], "dataset string, status string")
    chosen = spark.createDataFrame([("one", "a"), ("two", "a"), ("3", "b"), ("four", "a"), ("four", "z")], "dataset string, task string")
    got = read_catalogue(spark, root, status, chosen, "test")
    rows = sorted((r.dataset, r.task, r.n if r.n is not None else -1, r.text) for r in got.collect())
    assert rows == sorted([(d, t, i, None) for d, t in (("one", "a"), ("3", "b")) for i in range(4)] + [("four", "a", -1, "word")])
    for given, keys in ((got, 2), (read_catalogue(spark, root, status), 1), (read_catalogue(spark, root, chosen=chosen), 2)):
        assert given._jdf.queryExecution().optimizedPlan().toString().count("dynamicpruning") >= keys
    assert [(r.dataset, r.task) for r in unbuilt(read_catalogue(spark, root), chosen).collect()] == [("four", "z")]
    assert read_catalogue(spark, root).count() == len(parts) + 1


def test_missing_truth_is_an_error_row(spark, tmp_path):
    def talk(label):
        roles = [("system", "s"), ("user", "u"), ("assistant", json.dumps({"label": label}))]
        return [{"role": r, "content": c} for r, c in roles]

    folder = tmp_path / "mustard" / "video_context"
    folder.mkdir(parents=True)
    # Parquet with a field more than role and content.
    pq.write_table(pa.table({"messages": [[{**m, "note": "n"} for m in talk(x)] for x in (0, 1)]}), folder / "x_test.parquet")
    wanted = [("mustard-omni_video-context", "test"), ("mustard-omni_video-context", "dev"), ("meview-omni", "test"), ("nothing-known", "test"), ("meview-omni", "test")]
    truth, missing = load_truths(spark, str(tmp_path), wanted)
    assert truth.count() == 2
    told = {(r.task, r.split): r.error for r in missing.collect()}
    assert told == {
        ("mustard-omni_video-context", "dev"): "no truth table of split dev under mustard/video_context",
        ("meview-omni", "test"): "no truth table of split test under meview",
        ("nothing-known", "test"): "unknown dataset key: nothing-known",
    }
    answers = [("m", task, split, i, '{"label": 1}') for task, split in dict.fromkeys(wanted) for i in range(2)]
    predictions = spark.createDataFrame(answers, "model string, task string, split string, row_idx long, response string")
    summary = {(r.task, r.split): r for r in evaluate(predictions, truth, missing=missing).summary.collect()}
    assert {k: r.error for k, r in summary.items() if r.error} == told
    assert summary["mustard-omni_video-context", "test"].n_valid == 2 and len(summary) == 4


def test_no_truth_at_all(spark, tmp_path):
    truth, missing = load_truths(spark, str(tmp_path), [("meview-omni", "test")])
    assert truth.count() == 0 and missing.count() == 1 and load_truths(spark, str(tmp_path), [])[1].count() == 0
    assert truth.where(F.col("task").isNotNull()).columns == ["task", "split", "row_idx", "messages"]
