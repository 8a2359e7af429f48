"""Baseline-corrected metrics and normalised scorecards, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.tasks import TASKS


def _axis(name: str, task: str, metric: str, direction: str, sota: float | None, ceiling: float = 1.0):
    return (name, task, metric, direction, sota, 1.0, ceiling)


# Axis, task, metric, direction, published best, weight and ceiling of every level.
LEVELS = {
    "L1 · Perception": [
        _axis("GazeFollow", "gazefollow-vlm_val", "avg_dist", "down", 0.099),
        _axis("VAT\n(frame)", "vat-omni_frame_test", "dist", "down", 0.076),
        _axis("VAT\n(video)", "vat-omni_video_test", "dist", "down", 0.076),
        _axis("VocalSound", "vocalsound-omni_test", "accuracy", "up", 0.980),
        _axis("Proxemics", "proxemics-vlm_no-skeleton_test", "mAP", "up", 0.738),
        _axis("Proxemics\n(+skel.)", "proxemics-vlm_skeleton_test", "mAP", "up", 0.738),
        _axis("AffWild2\n(AU)", "affwild2-omni_au_val", "macro_au_f1", "up", 0.595),
        _axis("AffWild2\n(VA)", "affwild2-omni_va_val", "ccc_mean", "up", 0.6695),
        _axis("MSP-Podcast\n(VAD)", "msppodcast-omni_vad_test", "ccc_mean", "up", 0.6852),
    ],
    "L2 · Understanding": [
        _axis("VoxConverse\n(diarization)", "voxconverse-omni_diarization_test", "der", "down", 0.082),
        _axis("MMEW\n(apex)", "mmew_apex-emotion_val", "uar", "up", 0.836),
        _axis("MMEW\n(clip)", "mmew_clip-emotion_val", "uar", "up", 0.836),
        _axis("AffWild2\n(expr.)", "affwild2-omni_expr_val", "macro_f1", "up", 0.537),
        _axis("MELD\n(V+A)", "meld-omni_video-audio_test", "weighted_f1", "up", 0.718),
        _axis("MELD\n(audio)", "meld-omni_audio-only_test", "weighted_f1", "up", 0.601),
        _axis("MELD\n(V+T)", "meld-omni_video-transcript_test", "weighted_f1", "up", 0.718),
        _axis("EMOTIC\n(discrete)", "emotic-vlm_discrete_test", "mAP", "up", 0.381),
        _axis("EMOTIC\n(VAD)", "emotic-vlm_vad_test", "aae_mean", "down", 0.926, 2.0),
        _axis("PISC", "pisc-vlm_test", "mAP", "up", 0.805),
        _axis("VideoCoAtt\n(det.)", "videocoattention-vlm_detection_test", "accuracy", "up", 0.781),
        _axis("VideoCoAtt\n(loc.)", "videocoattention-vlm_localization_test", "l2_dist", "down", 0.0628),
        _axis("MSP-Podcast\n(labels)", "msppodcast-omni_labels_test", "macro_f1", "up", 0.472),
    ],
    "L3 · Theory of Mind": [
        _axis("MuStARD\n(w/ ctx)", "mustard-omni_video-context_test", "accuracy", "up", 0.774),
        _axis("MuStARD\n(w/o ctx)", "mustard-omni_video-no-context_test", "accuracy", "up", 0.774),
        _axis("UR-Funny\n(V+ctx)", "urfunny-omni_video-context_test", "accuracy", "up", 0.736),
        _axis("UR-Funny\n(V+A)", "urfunny-omni_video-audio_test", "accuracy", "up", 0.736),
        _axis("RLDD", "rldd-omni_test", "accuracy", "up", 0.964),
        _axis("MEVIEW", "meview-omni_test", "uar", "up", 0.685),
    ],
}


def axis_rows(levels: dict[str, list[tuple]] = LEVELS) -> list[tuple]:
    """(level, axis, task, metric, direction, sota, weight, ceiling)"""
    return [(level, *axis) for level, axes in levels.items() for axis in axes]


def baseline_of(task_split: Column) -> Column:
    """Baseline key of ``{task}_{split}``; NULL for tasks without one."""
    key = F.regexp_replace(task_split, r"_[^_]+$", "")
    table = F.create_map(*[F.lit(x) for k, t in TASKS.items() for x in (k, t.baseline)])
    return F.try_element_at(table, key)


def adjust(raw: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace the unusable share of a metric by the baseline.

    ``raw`` holds ``n_samples, n_valid, metric, value`` and ``baseline_key``;
    ``baseline`` holds ``baseline_key, metric, value``. Metrics without a
    baseline pass through with ``adjusted`` false.
    """
    naive = baseline.select("baseline_key", "metric", F.col("value").alias("naive"))
    known = F.col("naive").isNotNull() & (F.col("metric") != "n_used")
    mixed = (
        F.col("value") * F.col("n_valid") + F.col("naive") * (F.col("n_samples") - F.col("n_valid"))
    ) / F.col("n_samples")
    return (
        raw.join(naive, ["baseline_key", "metric"], "left")
        .withColumns({"adjusted": known, "score": F.when(known, mixed).otherwise(F.col("value"))})
        .drop("naive")
    )


def normalise(value: Column, direction: Column, ceiling: Column) -> Column:
    """Map a metric to [0, 1], 1 being best; missing and undefined values give 0."""
    share = value / ceiling
    up = F.greatest(F.lit(0.0), F.least(share, F.lit(1.0)))
    down = F.greatest(F.lit(0.0), 1 - share)
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(F.when(direction == "up", up).otherwise(down))


def _axes(source: DataFrame, keys: list[str], axes: list[tuple]) -> DataFrame:
    """Every axis entry for every row of ``source``."""
    names = ("level", "axis", "task", "metric", "direction", "sota", "weight", "ceiling")
    entries = [
        F.struct(*[F.lit(v).cast("double" if i >= 5 else "string").alias(n) for i, (n, v) in enumerate(zip(names, a))])
        for a in axes
    ]
    return source.select(*keys, F.inline(F.array(*entries)))


def _weighted(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    score = normalise(value, F.col("direction"), F.col("ceiling"))
    total = F.sum(F.col("weight") * score)
    return rows.groupBy(*keys, "level", "axis").agg(
        F.when(F.sum("weight") > 0, total / F.sum("weight")).otherwise(F.lit(0.0)).alias("score")
    )


def axis_scores(adjusted: DataFrame, axes: list[tuple], models: DataFrame | None = None) -> DataFrame:
    """Weighted mean per model and axis.

    ``adjusted`` holds ``model, task, metric, adjusted, score``. A corrected
    value that is missing or exactly 0 falls back to the uncorrected one.
    """
    models = models if models is not None else adjusted.select("model").distinct()
    best = adjusted.groupBy("model", "task", "metric").agg(
        F.max(F.when(F.col("adjusted"), F.col("score"))).alias("corrected"),
        F.max(F.when(~F.col("adjusted"), F.col("score"))).alias("plain"),
    )
    rows = _axes(models, ["model"], axes).join(best, ["model", "task", "metric"], "left")
    return _weighted(rows, ["model"], F.coalesce(F.nullif(F.col("corrected"), F.lit(0.0)), F.col("plain")))


def raw_axis_scores(raw: DataFrame, axes: list[tuple], models: DataFrame | None = None) -> DataFrame:
    """The same from uncorrected ``model, task, metric, value``."""
    models = models if models is not None else raw.select("model").distinct()
    rows = _axes(models, ["model"], axes).join(
        raw.select("model", "task", "metric", "value"), ["model", "task", "metric"], "left"
    )
    return _weighted(rows, ["model"], F.col("value"))


def naive_axis_scores(baseline: DataFrame, axes: list[tuple], key=baseline_of) -> DataFrame:
    """Axis scores of the naive predictors."""
    one = baseline.sparkSession.range(1)
    rows = _axes(one, ["id"], axes).withColumn("baseline_key", key(F.col("task")))
    rows = rows.join(baseline.select("baseline_key", "metric", "value"), ["baseline_key", "metric"], "left")
    return _weighted(rows, [], F.col("value"))


def published_axis_scores(spark, axes: list[tuple]) -> DataFrame:
    """Axis scores of the published best results; NULL when a value is missing."""
    rows = _axes(spark.range(1), ["id"], axes)
    scored = _weighted(rows, [], F.col("sota"))
    gaps = rows.groupBy("level", "axis").agg(F.count_if(F.col("sota").isNull()).alias("gaps"))
    return scored.join(gaps, ["level", "axis"]).select(
        "level", "axis", F.when(F.col("gaps") == 0, F.col("score")).alias("score")
    )


def level_scorecard(scored: DataFrame, models: list[str]) -> DataFrame:
    """One row per axis, one column per model."""
    return scored.groupBy("level", "axis").pivot("model", models).agg(F.first("score"))


def choose_models(results: DataFrame, shown: dict[str, bool]) -> DataFrame:
    """Hide the models switched off; unknown ones are shown."""
    hidden = [m for m, on in shown.items() if not on]
    return results.where(~F.col("model").isin(*hidden)) if hidden else results


def prefer_flat(files: DataFrame) -> DataFrame:
    """Result files ``model, path, flat``: files next to each other win over sub-directories."""
    any_flat = files.agg(F.max("flat")).scalar()
    return files.where(F.col("flat") == any_flat)
