"""Small cases for every registered metric, worked out by hand or by a direct formula."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tallyframe.metrics.registry import METRICS, run_metric


def score(spark, name, gts, preds, heads=None, strict=False):
    heads = heads or [None] * len(gts)
    rows = [("m", json.dumps(g), json.dumps(p), h) for g, p, h in zip(gts, preds, heads)]
    df = spark.createDataFrame(rows, "model string, gt string, pred string, head array<double>")
    df = df.withColumns({"gt": F.try_parse_json("gt"), "pred": F.try_parse_json("pred")})
    out = run_metric(name, df, ["model"], strict).collect()
    return {r.metric: r.value for r in out} | {"n_used": min((r.n_used for r in out), default=None)}


def test_all_metrics_are_present():
    assert len(METRICS) == 33


def test_units_use_classes_present_in_truth(spark):
    gts = [{"action_units": ["AU1", "AU2"]}, {"action_units": ["AU1"]}, {}]
    preds = [{"action_units": ["AU1"]}, {}, {"action_units": ["AU1", "AU4"]}]
    got = score(spark, "affwild2_au_f1", gts, preds)
    assert got["f1_AU1"] == pytest.approx(0.5)  # one hit, one miss, one false alarm
    assert got["f1_AU2"] == 0.0
    assert "f1_AU4" not in got  # never in the truth
    assert got["macro_au_f1"] == pytest.approx(0.25)


def test_units_without_any_truth_are_undefined(spark):
    got = score(spark, "affwild2_au_f1", [{"action_units": []}], [{"action_units": ["AU1"]}])
    assert math.isnan(got["macro_au_f1"])


def test_units_need_the_key(spark):
    got = score(spark, "mmew_au_f1", [{"action_units": ["AU5"]}] * 2, [{"action_units": ["AU5"]}, {}])
    assert got["f1_AU5"] == 1.0 and got["n_used"] == 1
    strict = score(spark, "mmew_au_f1", [{"action_units": ["AU5"]}] * 2, [{"action_units": ["AU5"]}, {}], strict=True)
    assert strict["mmew_au_f1_error"] is None and "f1_AU5" not in strict


def test_expression_macro_counts_absent_classes(spark):
    gts = [{"label": "Anger"}, {"label": "Fear"}, {"other": 1}]
    got = score(spark, "affwild2_expr_f1", gts, [{"label": "Anger"}, {}, {"label": "Anger"}])
    assert got["macro_f1"] == pytest.approx(1 / 8)
    assert got["f1_anger"] == 1.0 and got["f1_neutral"] == 0.0
    assert got["n_used"] == 2


def test_expression_without_truth_gives_zero(spark):
    assert score(spark, "affwild2_expr_f1", [{"x": 1}], [{"label": "Fear"}])["macro_f1"] == 0.0


def test_ccc(spark):
    gts = [{"valence": v, "arousal": 0.3} for v in (0.1, 0.5, -0.4)]
    got = score(spark, "affwild2_va_ccc", gts, gts)
    assert got["ccc_valence"] == pytest.approx(1.0)
    assert got["ccc_arousal"] == 0.0  # constant on both sides
    assert got["ccc_mean"] == pytest.approx(0.5)


def test_emotion_ap_with_annotator_union(spark):
    gts = [
        {"emotions_per_annotator": [["Anger"], ["Fear", "Anger"]]},
        {"emotions": ["Doubt/Confusion"]},
        {"emotions": ["Anger"]},
    ]
    preds = [{"emotions": ["Anger"]}, {"emotions": ["Anger"]}, {}]
    got = score(spark, "emotic_discrete_ap", gts, preds)
    # Hard labels: precision * recall + (1 - recall) * prevalence.
    assert got["ap_anger"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["ap_doubt_confusion"] == pytest.approx(1 / 3)
    assert got["mAP"] == pytest.approx((got["ap_anger"] + got["ap_fear"] + got["ap_doubt_confusion"]) / 3)


def test_always_positive_ap_is_prevalence(spark):
    gts = [{"relationship": r} for r in ("Friends", "Friends", "Family", "Couple")]
    got = score(spark, "pisc_map", gts, [{"relationship": "Friends"}] * 4)
    assert got["ap_friends"] == pytest.approx(0.5)
    assert got["mAP"] == pytest.approx((0.5 + 0.25 + 0.25) / 3)
    assert got["recall_friends"] == 1.0 and "ap_commercial" not in got


def test_relation_alias_and_null(spark):
    gts = [{"relationship": r} for r in ("Friends", "Family", "Couple")]
    preds = [{"social_relationship": "Friends"}, {"relationship": None}, {"relationship": "", "social_relationship": "Couple"}]
    got = score(spark, "pisc_accuracy", gts, preds)
    assert got["accuracy"] == 1.0 and got["n_used"] == 2
    assert got["macro_f1"] == pytest.approx(2 / 6)
    assert score(spark, "pisc_map", gts, preds)["recall_family"] == 0.0
    empty = score(spark, "pisc_accuracy", gts[:1], [{}])
    assert math.isnan(empty["accuracy"]) and empty["n_used"] == 0


def test_jaccard(spark):
    gts = [{"emotions": []}, {"emotions": ["A", "B"]}]
    got = score(spark, "emotic_discrete_jaccard", gts, [{"emotions": []}, {"emotions": ["B", "C"]}])
    assert got["mean_jaccard"] == pytest.approx((1 + 1 / 3) / 2)


def test_row_error_keeps_dimensions_before_the_failure(spark):
    gts = [{"vad_per_annotator": [{"valence": 2, "arousal": 4, "dominance": 6}, {"valence": 4, "arousal": 4, "dominance": 6}]}] * 2
    preds = [{"valence": 5, "arousal": 5, "dominance": 5}, {"valence": 3, "dominance": 6}]
    got = score(spark, "emotic_vad_aae", gts, preds)
    assert got["aae_valence"] == pytest.approx(1.0)  # errors 2 and 0
    assert got["aae_arousal"] == pytest.approx(1.0) and got["aae_dominance"] == pytest.approx(1.0)
    assert got["aae_mean"] == pytest.approx((2 + 0 + 1 + 1) / 4)
    assert got["n_used"] == 2


def test_gaze_distance_box_centre_and_annotators(spark):
    gts = [{"gaze_points": [[0, 0], [300, 400]]}, {"gaze_point": [100, 100]}, {"gaze_point": [1, 1]}]
    preds = [{"gaze_point": [0, 0]}, {"gaze_point": [0, 0, 200, 200]}, {"gaze_point": [1]}]
    got = score(spark, "gazefollow_distance", gts, preds)
    assert got["min_dist"] == pytest.approx(0.0) and got["avg_dist"] == pytest.approx(0.125)
    assert score(spark, "gazefollow_distance", gts[:1], [{"gaze_point": "x"}])["min_dist"] == 0.0


def test_gaze_angle(spark):
    gts = [{"gaze_point": [500, 0]}, {"gaze_point": [0, 500]}, {"gaze_point": [9, 9]}]
    preds = [{"gaze_point": [500, 500]}, {"gaze_point": [0, 0]}, {"gaze_point": [9, 9]}]
    heads = [[-10.0, -10.0, 10.0, 10.0], [0.0, 0.0, 0.0, 0.0], None]
    got = score(spark, "gazefollow_angular_error", gts, preds, heads)
    assert got["min_angular_error"] == pytest.approx((45 + 90) / 2)  # no direction counts as a right angle
    assert got["n_used"] == 2


def test_heatmap_auc_against_direct_count(spark):
    gts = [{"gaze_points": [[500, 500], [520, 480]]}, {"gaze_point": [100, 900]}, {"gaze_point": [0, 0]}]
    preds = [{"gaze_point": [510, 490]}, {"gaze_point": [900, 100]}, {"gaze_point": "none"}]

    import numpy as np

    def heat(points):
        total = np.zeros((64, 64), dtype=np.float32)
        for x, y in points:
            for j in range(64):
                for i in range(64):
                    far = np.float32(i - np.float32(x * 0.063)) ** 2 + np.float32(j - np.float32(y * 0.063)) ** 2
                    total[j, i] += np.exp(-far / np.float32(18))
        return total.ravel()

    def direct(gt, pred):
        target = heat(gt)
        on = target / target.max() >= 0.5
        given = heat([pred]) if pred else np.zeros(4096)
        wins = [(given[~on] < v).sum() + (given[~on] == v).sum() / 2 for v in given[on]]
        return sum(wins) / (on.sum() * (~on).sum())

    want = [direct([(500, 500), (520, 480)], (510, 490)), direct([(100, 900)], (900, 100)), direct([(0, 0)], None)]
    assert want[2] == 0.5
    assert score(spark, "gazefollow_auc", gts, preds)["auc"] == pytest.approx(sum(want) / 3, abs=1e-4)


def test_dialogue_labels_are_titled(spark):
    gts = [{"emotion": "joy"}, {}, {"emotion": "Anger"}]
    got = score(spark, "meld_weighted_f1", gts, [{"emotion": "JOY"}, {"emotion": ""}, {"emotion": "weird"}])
    assert got["f1_joy"] == 1.0 and got["f1_neutral"] == 1.0
    assert got["weighted_f1"] == pytest.approx(2 / 3) and got["macro_f1"] == pytest.approx(2 / 7)


def test_concealed_uar(spark):
    gts = [{"emotion": "anger"}, {"emotion": "anger"}, {"emotion": "fear"}]
    got = score(spark, "meview_uar", gts, [{"emotion": "Anger"}, {"emotion": "fear"}, {"emotion": "fear"}])
    assert got["accuracy"] == pytest.approx(2 / 3)
    assert got["uar"] == pytest.approx((0.5 + 1) / 6)


def test_micro_emotion_switches_its_classes(spark):
    gts = [{"emotion": "fear"}, {"emotion": "others"}]
    seven = score(spark, "mmew_emotion_accuracy", gts, gts)
    assert seven["macro_f1"] == pytest.approx(2 / 7) and seven["f1_others"] == 1.0
    six = score(spark, "mmew_emotion_accuracy", gts[:1], gts[1:])
    assert six["macro_f1"] == 0.0 and "f1_others" not in six


def test_speech_votes(spark):
    gts = [
        {"emotions_per_annotator": ["anger", "happiness"]},  # tie: class order
        {"emotion": "Fear"},  # no annotators: Neutral
        {"emotions_per_annotator": ["Fear", "Fear", "Anger"]},
    ]
    preds = [{"emotion": ["happiness "]}, {"emotion": "neutral"}, {"emotion": None}]
    got = score(spark, "msppodcast_labels_f1", gts, preds)
    assert got["f1_happiness"] == 1.0 and got["f1_neutral"] == 1.0 and got["n_used"] == 2
    first = score(spark, "msppodcast_labels_accuracy", gts[:1] + gts[2:], [{"emotion": "anger"}, {"emotion": "x"}])
    assert first["wa"] == 0.5 and first["ua"] == 0.5
    weighted = score(spark, "msppodcast_labels_weighted_f1", gts[2:], [{"emotion": "Fear"}])
    assert weighted["weighted_f1"] == 1.0


def test_speech_numbers(spark):
    anns = [{"arousal": 2, "valence": 4, "dominance": 1}, {"arousal": 4, "valence": 4, "dominance": 3}]
    gts = [{"vad_per_annotator": anns}, {"vad_per_annotator": anns[:1]}, {"vad_per_annotator": anns}]
    preds = [{"arousal": 3, "valence": [4], "dominance": "2"}, {"arousal": 2, "valence": 4, "dominance": 1}, {"arousal": 3}]
    got = score(spark, "msppodcast_vad_ccc", gts, preds)
    assert got["ccc_arousal"] == pytest.approx(1.0) and got["ccc_valence"] == 0.0 and got["n_used"] == 2
    error = score(spark, "msppodcast_vad_aae", gts[:1], [{"arousal": 4, "valence": 4, "dominance": 2}])
    assert error["aae_arousal"] == 1.0 and error["aae_mean"] == pytest.approx(1 / 3)


def test_sarcasm(spark):
    gts = [{"sarcasm": v} for v in (True, True, False, None)]
    got = score(spark, "mustard_f1", gts, [{"sarcasm": v} for v in (True, False, False, True)])
    assert got["accuracy"] == pytest.approx(2 / 3)
    assert got["precision"] == 1.0 and got["recall"] == 0.5
    assert got["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 2)
    none = score(spark, "mustard_f1", gts[3:], [{"sarcasm": True}])
    assert none["accuracy"] == 0.0 and none["recall"] == 0.0


def test_contacts(spark):
    gts = [{"touching": ["Hand touch hand"]}, {"touching": []}, {"touching": ["Hand touch hand"]}]
    preds = [{"touching_body_parts": [["Hand touch hand"]]}, {"touching": ["Hand touch elbow"]}, {"touching": "hands"}]
    exact = score(spark, "proxemics_accuracy", gts, preds)
    assert exact["exact_match_accuracy"] == 0.5 and exact["acc_hand_touch_elbow"] == 0.5 and exact["n_used"] == 2
    assert score(spark, "proxemics_map", gts, preds)["mAP"] == 1.0


def test_honesty(spark):
    gts = [{"label": "deceptive"}, {"label": "truthful"}, {"label": "truthful"}]
    hard = [{"label": "deceptive"}, {"label": "deceptive"}, {"label": "truthful"}]
    got = score(spark, "rldd_accuracy", gts, hard)
    assert got["accuracy"] == pytest.approx(2 / 3) and got["f1_truthful"] == pytest.approx(2 / 3)
    assert score(spark, "rldd_auc", gts, hard)["auc"] == pytest.approx((1 + 0.5) / 2)
    soft = [{"label": "deceptive", "confidence": c} for c in (0.4, 0.6, 0.4)]
    assert score(spark, "rldd_auc", gts, soft)["auc"] == pytest.approx(0.25)
    assert math.isnan(score(spark, "rldd_auc", gts[1:], hard[1:])["auc"])


def test_humor(spark):
    gts = [{"funny": 1}, {"funny": 0}, {"funny": 1}, {"funny": 0}]
    got = score(spark, "urfunny_f1", gts, [{"funny": "Yes"}, {"funny": False}, {"funny": "maybe"}, {"funny": 1.0}])
    assert got["accuracy"] == pytest.approx(2 / 3) and got["n_used"] == 3
    assert got["f1_funny"] == pytest.approx(2 / 3) and got["f1_not_funny"] == pytest.approx(2 / 3)


def test_targets(spark):
    gts = [{"gaze_point": [0, 0]}, {"out_of_frame": True}, {"gaze_point": [0, 300]}, {"gaze_point": [5, 5]}]
    preds = [
        {"gaze_point": ["300", 400]},
        {"gaze_point": [1, 1]},
        {"gaze_point": [0, 0, 0, 600], "out_of_frame": False},
        {"gaze_point": [1, 2, 3]},
    ]
    got = score(spark, "videoattentiontarget_distance", gts, preds)
    assert got["dist"] == pytest.approx((0.5 + 0.0) / 2) and got["n_used"] == 2
    far = score(spark, "videoattentiontarget_distance", gts[1:2], preds[1:2])
    assert math.isnan(far["dist"]) and far["n_used"] == 0
    scored = [{"out_of_frame": True, "out_of_frame_score": 0.2}, {"out_of_frame": True}, {}, {}]
    got = score(spark, "videoattentiontarget_out_of_frame_ap", gts, scored)
    assert got["out_of_frame_ap"] == 1.0 and got["out_of_frame_f1"] == pytest.approx(2 / 3)
    none = score(spark, "videoattentiontarget_out_of_frame_ap", gts[2:], scored[2:])
    assert math.isnan(none["out_of_frame_ap"]) and math.isnan(none["out_of_frame_f1"])


def test_joint_attention(spark):
    gts = [{"co_attention": v} for v in (True, False, True, True)]
    preds = [{"co_attention": True}, {"co_attention": 1}, {"co_attention": "x"}, {"co_attention": 0}]
    got = score(spark, "videocoattention_detection_f1", gts, preds)
    assert got["n_used"] == 3 and got["precision"] == 0.5 and got["recall"] == 0.5 and got["f1"] == 0.5


def test_boxes(spark):
    gts = [{"bbox": [0, 0, 100, 100]}, {"bbox": [0, 0, 10, 10]}, {"bbox": [5, 5, 5, 5]}]
    preds = [{"bbox": [50, 0, 150, 100]}, {"bbox": [1, 2, 3]}, {"bbox": [9, 9, 5, 5]}]
    got = score(spark, "videocoattention_localization_iou", gts, preds)
    assert got["mean_iou"] == pytest.approx((1 / 3 + 0) / 2)
    assert got["l2_dist"] == pytest.approx((0.05 + math.hypot(2, 2) / 1000) / 2)
    assert got["n_used"] == 2


def test_vocal_aliases_and_observed_macro(spark):
    gts = [{"vocal_sound": "Sigh"}, {"vocal_sound": "Cough"}, {"vocal_sound": "Sniff"}]
    got = score(spark, "vocalsound_accuracy", gts, [{"sound": "Sigh"}, {"Vocal Sound": "Cough"}, {"x": 1}])
    assert got["accuracy"] == pytest.approx(2 / 3)
    assert got["macro_f1"] == pytest.approx(2 / 4)  # Sigh, Cough, Sniff and the empty label
    assert got["f1_throat_clearing"] == 0.0


def test_speaker_count(spark):
    got = score(
        spark, "voxconverse_speaker_count_mae",
        [{"num_speakers": n} for n in (1, 2, 3)],
        [{"num_speakers": "3"}, {"num_speakers": 2.9}, {"num_speakers": None}],
    )
    assert got["mae"] == 1.0 and got["exact_accuracy"] == 0.5 and got["n_used"] == 2


def test_diarization(spark):
    line = ["A", "A", "AB", "-", "B", "B"]
    same = score(spark, "voxconverse_der", [{"timeline": line}], [{"timeline": [b.translate({65: 66, 66: 65}) for b in line]}])
    assert same["der"] == 0.0
    silent = score(spark, "voxconverse_der", [{"timeline": ["A", "A"]}, {"timeline": ["-", "-"]}], [{"timeline": ["-", "-"]}] * 2)
    assert silent["der"] == 0.5 and silent["missed_speech"] == 0.5  # silent rows stay in the denominator
    longer = score(spark, "voxconverse_der", [{"timeline": ["A"]}], [{"timeline": ["A", "A", "A"]}])
    assert longer["false_alarm"] == 2.0 and longer["der"] == 2.0
    # One long segment is covered by two others: false alarm and miss are counted per segment.
    clipped = score(spark, "voxconverse_der", [{"timeline": ["AB", "A", "-"]}], [{"timeline": ["C", "C", "C"]}])
    assert clipped["false_alarm"] == 0.0
    assert clipped["speaker_confusion"] == pytest.approx((3 - 0 - 2) / 3)
    missing = score(spark, "voxconverse_der", [{"timeline": ["A"]}], [{"x": 1}])
    assert math.isnan(missing["der"])


def test_run_metric_parses_each_answer_once(spark):
    rows = spark.createDataFrame([("a", '{"valence": 1, "arousal": 2}')], "grp string, text string")
    rows = rows.select("grp", F.try_parse_json("text").alias("gt"), F.try_parse_json("text").alias("pred"))
    got = run_metric("affwild2_va_ccc", rows, ["grp"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") in (1, 2)
    assert {r.metric for r in got.collect()} == {"ccc_valence", "ccc_arousal", "ccc_mean"}


def test_timelines_as_bits_agree_with_their_segments(spark):
    import random

    from tallyframe.functions import timeline as tl
    from tallyframe.metrics.diarization import PARTS, der_columns

    draw = random.Random(5)

    def line(names):
        return ["".join(sorted(draw.sample(names, draw.randrange(len(names) + 1)))) or "-" for _ in range(draw.randrange(70))]

    rows = [(i, line("ABCDE"), line("ABC")) for i in range(60)] + [(100, ["AA", "-"], ["A", "B"]), (101, None, ["A"]), (102, ["A1", None], ["1"])]
    pairs = spark.createDataFrame(rows, "i int, gt array<string>, pred array<string>")
    lengths = pairs.select("i", tl.lengths(F.col("gt"), F.col("pred")).alias("x")).orderBy("i").collect()
    assert all(r.x.ref is not None for r in lengths[:60]) and all(r.x is None or r.x.ref is None for r in lengths[60:])
    # A digit as one more speaker of both sides in a bin of its own keeps the path that follows the segments.
    text = lambda c: F.transform(F.col(c), lambda b: F.translate(b, "ABCDE", "12345"))
    slow = pairs.select("i", text("gt").alias("gt"), text("pred").alias("pred"))
    read = lambda df: {r.i: tuple(r[p] for p in PARTS) for r in der_columns(df).collect()}
    fast, followed = read(pairs), read(slow)
    assert {i: fast[i] for i in range(60)} == {i: followed[i] for i in range(60)}


def test_voxconverse_der_writes_its_timelines_once(spark):
    from tallyframe.queries.scored import metric_voxconverse_der

    assert not [f for f in metric_voxconverse_der(spark, "/root/testdata/sf0.001").inputFiles() if "events.parquet" in f]
