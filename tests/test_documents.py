"""Stored result documents, failing metrics, named text parsers and counted skips."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import messages as ms
from tallyframe.metrics.registry import METRICS, Metric, register_metric
from tallyframe.plans import documents as dc
from tallyframe.plans.evaluate import evaluate, results_document
from tallyframe.plans.tasks import TASKS, register_text_parser
from tallyframe.recipes import speech
from tallyframe.recipes.common import counting_skips, keep, write_counted

MUSTARD, FUNNY = "mustard-omni_video-context", "urfunny-omni_video-audio"


def plain_adjusted(document: dict, baselines: dict) -> dict:
    """The corrected entries of one document, entry by entry."""
    out = {}
    for name, entry in document["results"].items():
        if "error" in entry and "n_samples" not in entry:
            out[name] = entry
            continue
        n, valid = entry.get("n_samples", 0), entry.get("n_valid", 0)
        key = TASKS[name.rsplit("_", 1)[0]].baseline if name.rsplit("_", 1)[0] in TASKS else None
        adjusted, rest = {}, {}
        for metric, value in entry.get("metrics", {}).items():
            if isinstance(value, (int, float)):
                naive = baselines.get(key, {}).get(metric)
                if isinstance(naive, (int, float)) and metric != "n_used":
                    adjusted[metric] = (value * valid + naive * (n - valid)) / n
                else:
                    rest[metric] = float(value)
        out[name] = {
            "n_samples": n, "n_valid": valid, "n_invalid": n - valid, "format_compliance_rate": entry.get("format_compliance_rate"),
            "baseline_key": key, "metrics_adjusted": adjusted, "metrics_no_baseline": rest,
        }
    return out


BASELINES = {TASKS[MUSTARD].baseline: {"accuracy": 0.5, "n_used": 7, "note": "text", "precision": None}, TASKS[FUNNY].baseline: {"accuracy": 0.25}}
RAW = {
    "m one": {"results": {
        f"{MUSTARD}_test": {"n_samples": 10, "n_valid": 8, "format_compliance_rate": 0.8, "metrics": {"accuracy": 0.75, "recall": 1, "precision": 0.5, "n_used": 8, "x_error": "why", "ok": True}},
        f"{FUNNY}_val": {"n_samples": 4, "n_valid": 4, "metrics": {"accuracy": 0.1}},
        "no such_test": {"n_samples": 2, "n_valid": 0, "metrics": {}, "error": "no valid samples after parsing"},
        "lost_test": {"error": 'a "quoted" reason'},
    }},
    'm"2': {"metadata": {"a": [1]}, "results": {}},
    "m+3": {"results": {f"{MUSTARD}_test": {"n_samples": 3, "n_valid": 1, "metrics": {"accuracy": 0.0}}}},
}


def test_documents_are_corrected_entry_by_entry(spark, tmp_path):
    for model, document in RAW.items():
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / f"{model}.json").write_text(json.dumps(document))
    (tmp_path / "raw" / "sub").mkdir()
    (tmp_path / "raw" / "sub" / "metrics.json").write_text(json.dumps({"results": {}}))  # files beside it win
    (tmp_path / "baselines.json").write_text(json.dumps(BASELINES))
    raw = dc.scan_documents(spark, f"{tmp_path}/raw")
    baseline = dc.baseline_values(spark.read.text(f"{tmp_path}/baselines.json", wholetext=True).withColumnRenamed("value", "document"))
    got = {r.model: json.loads(r.document) for r in dc.adjusted_documents(raw, baseline).collect()}
    assert set(got) == set(RAW)
    for model, document in RAW.items():
        assert got[model]["model"] == model and got[model]["source"].startswith("file:")
        want = plain_adjusted(document, BASELINES)
        assert set(got[model]["results"]) == set(want)
        for name, entry in want.items():
            mine = got[model]["results"][name]
            for field in ("metrics_adjusted", "metrics_no_baseline"):
                assert mine.pop(field, None) == pytest.approx(entry.pop(field, None))
            assert mine == entry


def test_folders_of_models_and_bare_numbers(spark, tmp_path):
    for model in ("a", "b", "adjusted"):
        (tmp_path / model).mkdir()
        (tmp_path / model / "metrics.json").write_text(
            '{"results": {"%s_test": {"n_samples": 2, "n_valid": 1, "metrics": {"accuracy": NaN, "der": Infinity, "uar": 0.5}}}}' % MUSTARD
        )
        (tmp_path / model / "other.json").write_text("{}")
    raw = dc.scan_documents(spark, str(tmp_path))
    assert sorted(r.model for r in raw.collect()) == ["a", "b"]
    values = {(r.model, r.metric): r.value for r in dc.metric_values(dc.entries(raw)).collect()}
    assert values["a", "uar"] == 0.5 and values["b", "der"] == float("inf") and values["a", "accuracy"] != values["a", "accuracy"]


def test_no_samples_and_no_json(spark):
    rows = [("m", "p", json.dumps({"results": {f"{MUSTARD}_test": {"n_samples": 0, "n_valid": 0, "metrics": {"accuracy": 0.5}}}})), ("n", "p", "no json"), ("o", "p", "[1]")]
    raw = spark.createDataFrame(rows, "model string, path string, document string")
    baseline = spark.createDataFrame([(TASKS[MUSTARD].baseline, "accuracy", 0.5)], "baseline_key string, metric string, value double")
    got = {r.model: json.loads(r.document)["results"] for r in dc.adjusted_documents(raw, baseline).collect()}
    assert got["m"][f"{MUSTARD}_test"]["metrics_adjusted"] == {"accuracy": None}
    assert got["n"] == got["o"] == {}


@pytest.fixture(scope="module")
def answers(spark):
    def chat(answer):
        return [("assistant", json.dumps(answer))]

    truth = [(MUSTARD, "test", i, chat({"sarcasm": i % 2 == 0})) for i in range(6)] + [("meview-omni", "test", i, chat({"emotion": e})) for i, e in enumerate(["fear", "happy"])]
    given = [(m, MUSTARD, "test", i, json.dumps({"sarcasm": i % 3 == 0})) for m in ("one", "two", "three") for i in range(6)]
    given += [("one", "meview-omni", "test", 0, "She seems 'Fear' struck"), ("one", "meview-omni", "test", 1, "no idea")]
    columns = "task string, split string, row_idx long"
    return spark.createDataFrame(given, f"model string, {columns}, response string"), spark.createDataFrame(truth, f"{columns}, messages {ms.MESSAGES}")


def test_chain_from_answers_to_a_card(spark, answers, tmp_path):
    out = results_document(evaluate(*answers)).withColumn("path", F.lit("x"))
    rows = [(TASKS[MUSTARD].baseline, "accuracy", 0.5), (TASKS["meview-omni"].baseline, "uar", 0.2)]
    baseline = spark.createDataFrame(rows, "baseline_key string, metric string, value double")
    again = dc.baseline_values(dc.baselines_document(baseline))
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    card = {(r.model, r.axis): r.score for r in dc.scorecard(dc.adjusted_documents(out, again)).collect()}
    assert len(card) == 3 * 28
    assert card["one", "MuStARD\n(w/ ctx)"] == pytest.approx(3 / 6)
    # One of two answers is right on the only class it names; the other is a parse failure and counts as the baseline.
    raw = json.loads(out.where("model = 'one'").first().document)["results"]["meview-omni_test"]
    assert (raw["n_samples"], raw["n_valid"], raw["n_parse_failures"]) == (2, 1, 1)
    assert card["one", "MEVIEW"] == pytest.approx((raw["metrics"]["uar"] + 0.2) / 2)
    assert card["two", "MEVIEW"] == 0.0


def test_a_failing_metric_is_contained(spark, answers):
    def compute(rows, by):
        bad = F.when(F.col("model").isin("two"), F.raise_error(F.lit("broken for two"))).otherwise(F.lit(2.0))
        return rows.groupBy(*by).agg(F.avg(bad).alias("value"), F.count("*").alias("n_used")).select(*by, F.lit("two").alias("metric"), "value", "n_used")

    def hopeless(rows, by):
        raise KeyError("emotion")

    register_metric("breaks", Metric(compute))
    register_metric("hopeless", Metric(hopeless))
    try:
        tasks = TASKS | {MUSTARD: replace(TASKS[MUSTARD], metrics=("mustard_f1", "breaks", "hopeless"))}
        out = evaluate(*answers, tasks=tasks)
        values = {(r.model, r.metric): r.value for r in out.metrics.where(F.col("task") == MUSTARD).collect()}
        errors = {(r.model, r.metric): r.error for r in out.errors.collect()}
        documents = {r.model: json.loads(r.document)["results"][f"{MUSTARD}_test"]["metrics"] for r in results_document(out).collect()}
    finally:
        del METRICS["breaks"], METRICS["hopeless"]
    assert values["one", "two"] == values["three", "two"] == 2.0
    assert ("two", "two") not in values and values["two", "breaks_error"] is None
    assert "broken for two" in errors["two", "breaks_error"]
    assert {m for m, e in errors if e == "hopeless_error"} == {"one", "two", "three"}
    assert errors["one", "hopeless_error"] == "'emotion'"
    assert all((m, "accuracy") in values for m in ("one", "two", "three"))
    assert "broken for two" in documents["two"]["breaks_error"] and documents["one"]["two"] == 2.0


def test_text_parsers_are_functions_of_the_session(spark, answers):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def shouted(text):
        return text.map(lambda t: '{"emotion": "happy"}' if t and "idea" in t else None)

    spark.udf.register("shouted_emotion", shouted)
    tasks = TASKS | {"meview-omni": replace(TASKS["meview-omni"], text_parser="shouted_emotion")}
    row = evaluate(*answers, tasks=tasks).summary.where("task = 'meview-omni'").first()
    assert (row.n_valid, row.n_parse_failures) == (1, 1)
    register_text_parser(spark, "which_pet", ["cat", "dog"], "pet")
    got = [r[0] for r in spark.sql("SELECT which_pet(t) FROM VALUES ('a Dog, \"cat\", dog'), ('dogs'), (NULL), ('cat dog') AS v(t)").collect()]
    assert got == ['{"pet":"cat"}', None, None, '{"pet":"dog"}']
    with pytest.raises(ValueError, match="no function"):
        evaluate(*answers, tasks={"meview-omni": replace(TASKS["meview-omni"], text_parser="nowhere", text_classes=())})


def test_skips_are_counted_by_the_write(spark, tmp_path):
    codes = list(speech.VOCAL_CODES)
    entries = spark.createDataFrame([(f"/x/{i}.wav", codes[0] if i % 4 else "?") for i in range(40)], "wav string, labels string")
    listing = spark.createDataFrame([(f"{i}.wav",) for i in range(0, 40, 2)], "path string")
    counts = write_counted(lambda: speech.vocalsound(entries, "test", listing), f"{tmp_path}/v")
    assert counts == {"unknown label": 10, "missing file": 20}
    assert spark.read.parquet(f"{tmp_path}/v").count() == 10
    # A listing without any file: Spark may leave the rest of the plan out.
    counts = write_counted(lambda: speech.vocalsound(entries, "test", listing.limit(0)), f"{tmp_path}/w")
    assert counts["missing file"] in (30, 0) and spark.read.schema("sample_id string").parquet(f"{tmp_path}/w").count() == 0


def test_plans_have_no_counters_unless_asked(spark):
    rows = spark.range(100)
    plain = keep(rows, F.col("id") > 10, "small")
    with counting_skips() as skips:
        counted = keep(keep(rows, F.when(F.col("id") != 5, F.col("id") > 10), "small"), lambda r: r.where("id < 50"), "large")
    assert "CollectMetrics" not in plain._jdf.queryExecution().toString()
    assert counted.count() == 39
    assert skips.counts() == {"small": 11, "large": 50}
