"""Readers, writers and a scoring run over real files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import messages as ms
from tallyframe.functions import parse as ps
from tallyframe.metrics.registry import METRICS, Metric, register_metric
from tallyframe.plans import baselines as bl
from tallyframe.plans import score as sc
from tallyframe.plans.evaluate import evaluate, results_document
from tallyframe.plans.tasks import TASKS, task_table
from tallyframe.sources import readers as rd
from tallyframe.sources import writers as wr


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return str(path)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    text = "\n".join(f"line {i}" for i in range(2000))
    put(tmp_path, "a.txt", text)
    put(tmp_path, "b.txt", "x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = rd.number_lines(rd.read_lines(spark, str(tmp_path)))
        assert rows.select("block").distinct().count() > 5
        got = {(r.file[-5:], r.line_no): r.value for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["a.txt", 1999] == "line 1999" and got["a.txt", 0] == "line 0" and got["b.txt", 1] == "y"
    assert all(got["a.txt", i] == f"line {i}" for i in range(2000))


def test_jsonl_drops_bad_lines_before_numbering(spark, tmp_path):
    lines = ['{"response": "a"}', "", "{broken", '{"response": "b", "x": {"y": 1}}', '{"response": 1} tail', "[1]", '{"response": NaN}']
    path = put(tmp_path, "PRED_mustard-omni_video-context_test.jsonl", "\n".join(lines))
    got = {r.row_idx: r.value for r in rd.scan_jsonl(spark, path).collect()}
    assert got == {0: lines[0], 1: lines[3], 2: lines[5], 3: lines[6]}


def test_keyed_json(spark, tmp_path):
    path = put(tmp_path, "k.json", json.dumps({"a": {"sarcasm": True}, "b": {"sarcasm": False}}))
    got = rd.scan_keyed_json(spark, path, "struct<sarcasm:boolean>").collect()
    assert {r.key: r.value.sarcasm for r in got} == {"a": True, "b": False}
    path = put(tmp_path, "l.json", "[3, 4]")
    assert [r.value for r in rd.scan_keyed_json(spark, path, "int", keyed=False).orderBy("position").collect()] == [3, 4]


def test_csv_header_is_trimmed(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'Split, Dialogue ID,X\ntrain,7,"a, b"\ndev,x,c\n')
    got = rd.scan_csv(spark, path, {"Split": "string", "Dialogue ID": "int", "X": "string", "absent": "int"}).collect()
    assert [tuple(r) for r in got] == [("train", 7, "a, b"), ("dev", None, "c")]


def test_delimited_and_variable_arity(spark, tmp_path):
    path = put(tmp_path, "d.txt", "p.jpg,0-1,0.5\nshort\np.jpg,0-2,bad\nq.jpg, 1-1 ,1\n")
    got = rd.scan_delimited(spark, path, {"path": (0, "string"), "idx": (1, "string"), "x": (2, "double")}, min_fields=3)
    assert sorted((r.line_no, r.path, r.idx, r.x) for r in got.collect()) == [(0, "p.jpg", "0-1", 0.5), (3, "q.jpg", "1-1", 1.0)]
    path = put(tmp_path, "v.txt", "1 5 0 0 9 9 1 1 2 2\n1 6 0 0 9 9 1 1 2\n1 7 0 0 9 9 1 1 2 2 3 3 4 4 5\n")
    got = rd.scan_variable_arity(spark, path).orderBy("line_no").collect()
    assert [len(r.groups) for r in got] == [1, 2] and got[1].groups[1] == [3, 3, 4, 4]


def test_frame_annotations_shift_after_bad_lines(spark, tmp_path):
    path = put(tmp_path, "clip1.txt", "header\n3\n\nx\n-1\n4\n")
    got = rd.scan_frame_annotations(spark, path, "int").orderBy("frame").collect()
    assert [(r.clip, r.frame, r.value) for r in got] == [("clip1", 0, 3), ("clip1", 1, -1), ("clip1", 2, 4)]
    path = put(tmp_path, "clip2.txt", "valence,arousal\n0.1,0.2\n0.3\n-5,1,7\n")
    got = rd.scan_frame_annotations(spark, path, "pair").orderBy("frame").collect()
    assert [r.value for r in got] == [[0.1, 0.2], [-5.0, 1.0]]
    path = put(tmp_path, "clip3.txt", "AU1,AU2\n0,1\n0,z\n1,-1\n")
    got = rd.scan_frame_annotations(spark, path, "vector").orderBy("frame").collect()
    assert [r.value for r in got] == [[0, 1], [1, -1]]


def test_rttm(spark, tmp_path):
    path = put(tmp_path, "abc.rttm", "SPKR-INFO x\nSPEAKER abc 1 1.50 2.0 <NA> <NA> s1 <NA> <NA>\nSPEAKER abc 1 0.5 1 <NA> <NA> s2 <NA> <NA>\n")
    got = rd.scan_rttm(spark, path).orderBy("start").collect()
    assert [(r.clip, r.start, r.end, r.speaker) for r in got] == [("abc", 0.5, 1.5, "s2"), ("abc", 1.5, 3.5, "s1")]


def test_media(spark, tmp_path):
    for name, data in (("x/a.avi", b"1"), ("y/a.mp4", b"22"), ("x/b.avi", b"333"), ("x/c.txt", b"4")):
        put(tmp_path, name, data)
    listed = {r.stem: (r.path[-5:], r.length) for r in rd.list_media(spark, str(tmp_path), ["mp4", "avi"]).collect()}
    assert listed == {"a": ("a.mp4", 2), "b": ("b.avi", 3)}
    media = rd.media_bytes(spark, str(tmp_path))
    rows = media.select(F.col("path").alias("p")).unionByName(spark.createDataFrame([("nowhere",)], "p string"))
    found, missing = rd.attach_media(rows, media, "p")
    assert found.count() == 4 and missing.first().n_skipped == 1


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("d", "t", "test", i) for i in range(5)], "dataset string, task string, split string, i int")
    wr.write_samples(rows, str(tmp_path / "s"), max_rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 5
    blobs = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, bytearray(b"y"))], "id int, content binary")
    kept = wr.write_blobs(blobs, str(tmp_path / "b")).collect()
    assert len({r.digest for r in kept}) == 2 and spark.read.parquet(str(tmp_path / "b")).count() == 2
    assert wr.drop_metadata(spark.range(1).withColumn("clip_id", F.lit(1))).columns == ["id"]


ANSWERS = [True, False, True, True]
RESPONSES = ['{"sarcasm": true}', '<think>no</think>{"sarcasm": true}', "nothing", '{"sarcasm": true, "x": {"y": 1}}']


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    rows = [([("system", "s"), ("user", "u"), ("assistant", json.dumps({"sarcasm": a}))],) for a in ANSWERS]
    truth = spark.createDataFrame(rows, f"messages {ms.MESSAGES}").coalesce(1)
    root = folder / "parquets"
    target = root / "mustard" / "video_context"
    truth.write.parquet(str(folder / "once"))
    target.mkdir(parents=True)
    part = next((folder / "once").glob("part-*.parquet"))
    (target / "mustard_video_context_test.parquet").write_bytes(part.read_bytes())
    lines = [json.dumps({"response": r}) for r in RESPONSES]
    put(folder, "one/PRED_mustard-omni_video-context_test.jsonl", "\n".join([lines[0], "{bad", *lines[1:], lines[0]]))
    put(folder, "one/PRED_unknown_thing_test.jsonl", lines[0])
    return str(folder), str(root)


def test_scoring_run(spark, run):
    folder, root = run
    predictions = rd.scan_predictions(spark, f"{folder}/one")
    truth = rd.load_truth(spark, root, "mustard-omni_video-context", "test")
    out = evaluate(predictions, truth)
    summary = {r.task: r for r in out.summary.collect()}
    row = summary["mustard-omni_video-context"]
    assert (row.n_samples, row.n_valid, row.n_parse_failures, row.n_metric_valid) == (4, 3, 1, 3)
    assert row.format_compliance_rate == 0.75 and row.parse_failure_pct == 25.0 and row.below_floor
    assert summary["unknown_thing"].error == "unknown dataset key: unknown_thing"
    values = {r.metric: r.value for r in out.metrics.collect()}
    assert values["accuracy"] == pytest.approx(2 / 3)
    document = json.loads(results_document(out).where("model = 'one'").first().document)
    assert document["results"]["mustard-omni_video-context_test"]["metrics"]["recall"] == 1.0
    wr.write_results(results_document(out), f"{folder}/results")
    capped = evaluate(predictions, truth, max_samples=1).summary.where("n_samples IS NOT NULL").first()
    assert (capped.n_samples, capped.n_valid) == (1, 1)


def test_head_box_comes_from_the_prompt(spark):
    def chat(box, answer):
        return [("user", f"head {box}"), ("assistant", json.dumps(answer))]

    truth = spark.createDataFrame(
        [("gazefollow-vlm", "validation", "a", chat("[0, 0, 0, 0]", {"gaze_point": [0, 500]})),
         ("gazefollow-vlm", "validation", "b", chat("none", {"gaze_point": [0, 500]})),
         ("meview-omni", "test", "c", chat("", {"emotion": "fear"}))],
        f"task string, split string, id string, messages {ms.MESSAGES}",
    )
    predictions = spark.createDataFrame(
        [("m", "gazefollow-vlm", "val", "a", '{"gaze_point": [500, 500]}', None),
         ("m", "gazefollow-vlm", "val", "b", '{"gaze_point": [0, 0]}', [("user", "at [0, 0, 0, 0]")]),
         ("m", "meview-omni", "test", "c", "It shows Fear.", None)],
        f"model string, task string, split string, id string, response string, messages {ms.MESSAGES}",
    )
    got = {(r.task, r.metric): r.value for r in evaluate(predictions, truth, align="id").metrics.collect()}
    assert got["gazefollow-vlm", "min_angular_error"] == pytest.approx((45 + 90) / 2)
    assert got["gazefollow-vlm", "avg_dist"] == pytest.approx(0.5)
    assert got["meview-omni", "accuracy"] == 1.0


def test_no_usable_answer_is_an_error(spark, run):
    _, root = run
    truth = rd.load_truth(spark, root, "mustard-omni_video-context", "test")
    bad = spark.createDataFrame(
        [("m", "mustard-omni_video-context", "test", 0, "none")], "model string, task string, split string, row_idx long, response string"
    )
    row = evaluate(bad, truth).summary.first()
    assert row.error == "no valid samples after parsing" and row.n_valid == 0


def test_free_text_fallback(spark):
    text = "I saw anger, then \"Disgust\" and fear"
    df = spark.createDataFrame([(text,), ("so Happy it hurts, unhappy",), ("none",)], "t string")
    words = df.select(ps.parse_free_text(F.col("t"), list(TASKS["meview-omni"].text_classes), "emotion").alias("j")).collect()
    assert [r.j for r in words] == ['{"emotion":"disgust"}', '{"emotion":"happy"}', None]


def test_json_text_messages(spark, tmp_path):
    text = json.dumps([{"role": "assistant", "content": "x"}])
    spark.createDataFrame([(text,)], "messages string").write.parquet(str(tmp_path / "m"))
    assert rd.scan_messages(spark, str(tmp_path / "m")).first().messages[0].content == "x"


def test_user_metric(spark):
    def compute(rows, by):
        return rows.groupBy(*by).agg(F.count("*").alias("n_used")).select(
            *by, F.lit("rows").alias("metric"), F.col("n_used").cast("double").alias("value"), "n_used"
        )

    register_metric("row_count", Metric(compute))
    try:
        with pytest.raises(ValueError):
            register_metric("row_count", Metric(compute))
    finally:
        del METRICS["row_count"]


def test_baseline_report(spark):
    def chat(answer):
        return [("assistant", json.dumps(answer))]

    rows = [
        ("rldd-omni", "train", 0, chat({"label": "truthful"})),
        ("rldd-omni", "train", 1, chat({"label": "deceptive"})),
        ("rldd-omni", "test", 0, chat({"label": "truthful"})),
        ("rldd-omni", "test", 1, chat({"label": "deceptive"})),
        ("gazefollow-vlm", "validation", 0, chat({"gaze_points": [[500, 500], [500, 1000]]})),
        ("affwild2-omni_va", "train", 0, chat({"valence": 0.5, "arousal": 0.1})),
        ("affwild2-omni_va", "val", 0, chat({"valence": 0.1, "arousal": 0.1})),
        ("affwild2-omni_va", "val", 1, chat({"valence": 0.3, "arousal": 0.2})),
        ("mmew_apex-au", "train", 0, chat({"action_units": ["AU1", "AU2"]})),
        ("mmew_apex-au", "train", 1, chat({"action_units": ["AU1"]})),
        ("mmew_apex-au", "val", 0, chat({"action_units": ["AU1", "AU2"]})),
        ("proxemics-vlm_skeleton", "test", 0, chat({"touching": ["Hand touch hand"]})),
        ("proxemics-vlm_skeleton", "test", 1, chat({"touching": []})),
        ("voxconverse-omni_diarization", "test", 0, chat({"timeline": ["A", "B", "-", "A"]})),
        ("meld-omni_audio-only", "train", 0, [("assistant", '<think>x</think>\n{"emotion": "Joy"}')]),
        ("meld-omni_audio-only", "test", 0, chat({"emotion": "Joy"})),
    ]
    truth = spark.createDataFrame(rows, f"task string, split string, row_idx long, messages {ms.MESSAGES}")
    got = {(r.baseline_key, r.metric): r.value for r in bl.baseline_report(truth).collect()}
    assert got["rldd", "accuracy"] == 0.5 and got["rldd", "f1_truthful"] == pytest.approx(2 / 3)  # first seen wins
    assert got["gazefollow", "avg_dist"] == pytest.approx(0.25)
    assert got["affwild2_va", "ccc_mean"] == 0.0
    assert got["mmew_au", "f1_AU1"] == 1.0 and got["mmew_au", "f1_AU2"] == 0.0
    assert got["proxemics_skel", "mAP"] == 0.5  # prevalence
    assert got["voxconverse_diar", "der"] == pytest.approx(2 / 3)
    assert got["meld_audio_only", "weighted_f1"] == 1.0
    assert got["meview", "uar"] == pytest.approx(1 / 6)


def test_correction_and_normalisation(spark):
    raw = spark.createDataFrame(
        [("m", "t", "acc", 0.9, 10, 8, "b"), ("m", "t", "own", 0.4, 10, 8, "b"), ("m", "t", "acc2", 0.9, 5, 5, "b")],
        "model string, task string, metric string, value double, n_samples long, n_valid long, baseline_key string",
    )
    base = spark.createDataFrame([("b", "acc", 0.5), ("b", "acc2", 0.1)], "baseline_key string, metric string, value double")
    got = {r.metric: (r.adjusted, r.score) for r in sc.adjust(raw, base).collect()}
    assert got["acc"] == (True, pytest.approx((0.9 * 8 + 0.5 * 2) / 10))
    assert got["own"] == (False, 0.4)
    assert got["acc2"] == (True, pytest.approx(0.9))  # all valid: unchanged
    cases = [(0.5, "up", 1.0), (3.0, "up", 1.0), (-1.0, "up", 1.0), (0.5, "down", 2.0), (9.0, "down", 2.0), (None, "down", 1.0), (float("nan"), "up", 1.0)]
    df = spark.createDataFrame(cases, "v double, d string, c double")
    scores = [r.s for r in df.select(sc.normalise(F.col("v"), F.col("d"), F.col("c")).alias("s")).collect()]
    assert scores == [0.5, 1.0, 0.0, 0.75, 0.0, 0.0, 0.0]


def test_corrected_zero_falls_back(spark):
    axes = [("L", "a", "t", "acc", "up", None, 1.0, 1.0)]
    rows = spark.createDataFrame(
        [("m", "t", "acc", True, 0.0), ("m", "t", "acc", False, 0.3)], "model string, task string, metric string, adjusted boolean, score double"
    )
    assert sc.axis_scores(rows, axes).first().score == pytest.approx(0.3)
    assert sc.published_axis_scores(spark, axes).first().score is None


def test_registry(spark):
    assert len(TASKS) == 32 and task_table(spark).count() == 32
    assert len(sc.axis_rows()) == 28
    assert all(m in METRICS for t in TASKS.values() for m in t.metrics)
    files = spark.createDataFrame([("a", "x.json", True), ("b", "d/metrics.json", False)], "model string, path string, flat boolean")
    assert [r.model for r in sc.prefer_flat(files).collect()] == ["a"]


def test_baseline_report_reads_its_answers_once(spark):
    from tallyframe.plans import baselines as bl

    seen = spark.sparkContext.accumulator(0)
    rows = [("voxconverse-omni_speaker-count", "train" if i % 2 else "test", i, [("assistant", '{"num_speakers": %d}' % (i % 3))]) for i in range(12)]
    schema = "task string, split string, row_idx long, messages array<struct<role:string,content:string>>"

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    truth = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    got = {(r.baseline_key, r.metric): r.n_used for r in bl.baseline_report(truth).collect()}
    assert got["voxconverse_speaker", "mae"] == 6
    assert seen.value == 12
