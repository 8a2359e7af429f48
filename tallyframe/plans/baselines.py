"""Naive predictors learnt from training answers, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.binding import once
from tallyframe.operators.select import majority_label
from tallyframe.session import checkpoint, staged

# The centre of the 0..1000 grid as a point and as a box.
CENTER_POINT = [500, 500]
CENTER_BOX = [250, 250, 750, 750]


def constant_point() -> Column:
    return F.array(*[F.lit(float(v)) for v in CENTER_POINT])


def constant_box() -> Column:
    return F.array(*[F.lit(float(v)) for v in CENTER_BOX])


def all_labels(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def single_speaker(timeline: Column) -> Column:
    """One speaker talking in every bin."""
    return F.transform(timeline, lambda _: F.lit("A"))


def attach(test: DataFrame, learnt: DataFrame, by: list[str]) -> DataFrame:
    """Give every test row the predictor of its group (one row per group)."""
    if by:
        return test.join(learnt, by)
    names = learnt.columns
    # Scalar subqueries: a single value each, no join.
    return test.withColumns({n: learnt.select(n).scalar() for n in names})


def majority(train: DataFrame, by: list[str], label: str = "gt", seen: str | None = None) -> DataFrame:
    """Most frequent training answer per group as ``pred``; also the mode of a count."""
    best = majority_label(train, by, label, seen=seen)
    return best.select(*by, F.col(label).alias("pred"))


def frequent_labels(
    train: DataFrame, by: list[str], classes: list[str], labels: str = "gt", threshold: float = 0.5
) -> DataFrame:
    """Labels given in more than ``threshold`` of the training rows, in class order."""
    shares = train.groupBy(*by).agg(
        *[F.avg(F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("double")).alias(f"c{i}") for i, c in enumerate(classes)]
    )
    chosen = F.array(*[F.when(F.col(f"c{i}") > threshold, F.lit(c)) for i, c in enumerate(classes)])
    return shares.select(*by, F.filter(chosen, lambda c: c.isNotNull()).alias("pred"))


def train_mean(train: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """Training mean of every dimension as ``pred_<dim>``; missing values are left out."""
    return train.groupBy(*by).agg(*[F.avg(F.col(f"gt_{d}").cast("double")).alias(f"pred_{d}") for d in dims])


def uniform_recall(n_classes: int) -> float:
    """Unweighted recall of a constant answer."""
    return 1 / n_classes


# How each task is answered naively. Strategy, answer key(s) and metrics per baseline key.
STRATEGIES: dict[str, tuple[str, str, tuple[str, ...], tuple[str, ...]]] = {
    "gazefollow": ("gazefollow-vlm", "point", ("gaze_point",), ("gazefollow_distance",)),
    "vat_frame": ("vat-omni_frame", "point", ("gaze_point",), ("videoattentiontarget_distance",)),
    "vat_video": ("vat-omni_video", "point", ("gaze_point",), ("videoattentiontarget_distance",)),
    "vocalsound": ("vocalsound-omni", "majority", ("vocal_sound",), ("vocalsound_accuracy",)),
    "voxconverse_speaker": (
        "voxconverse-omni_speaker-count", "majority", ("num_speakers",), ("voxconverse_speaker_count_mae",),
    ),
    "proxemics_no_skel": ("proxemics-vlm_no-skeleton", "all:contacts", ("touching",), ("proxemics_map",)),
    "proxemics_skel": ("proxemics-vlm_skeleton", "all:contacts", ("touching",), ("proxemics_map",)),
    "mmew_au": ("mmew_apex-au", "frequent:au17", ("action_units",), ("mmew_au_f1",)),
    "mmew_apex_emotion": ("mmew_apex-emotion", "majority", ("emotion",), ("mmew_emotion_accuracy",)),
    "mmew_clip_emotion": ("mmew_clip-emotion", "majority", ("emotion",), ("mmew_emotion_accuracy",)),
    "affwild2_au": ("affwild2-omni_au", "frequent:au12", ("action_units",), ("affwild2_au_f1",)),
    "affwild2_va": ("affwild2-omni_va", "mean", ("valence", "arousal"), ("affwild2_va_ccc",)),
    "affwild2_expr": ("affwild2-omni_expr", "majority", ("label",), ("affwild2_expr_f1",)),
    "msppodcast_vad": (
        "msppodcast-omni_vad", "mean", ("valence", "arousal", "dominance"), ("msppodcast_vad_ccc",),
    ),
    "msppodcast_labels": ("msppodcast-omni_labels", "majority", ("emotion",), ("msppodcast_labels_f1",)),
    "voxconverse_diar": ("voxconverse-omni_diarization", "one speaker", ("timeline",), ("voxconverse_der",)),
    "meld_video_audio": ("meld-omni_video-audio", "majority", ("emotion",), ("meld_weighted_f1",)),
    "meld_audio_only": ("meld-omni_audio-only", "majority", ("emotion",), ("meld_weighted_f1",)),
    "meld_video_transcript": ("meld-omni_video-transcript", "majority", ("emotion",), ("meld_weighted_f1",)),
    "emotic_discrete": ("emotic-vlm_discrete", "all:emotions", ("emotions",), ("emotic_discrete_ap",)),
    "emotic_vad": ("emotic-vlm_vad", "mean", ("valence", "arousal", "dominance"), ("emotic_vad_aae",)),
    "pisc": ("pisc-vlm", "majority", ("relationship",), ("pisc_accuracy", "pisc_map")),
    "videocoatt_detection": (
        "videocoattention-vlm_detection", "majority", ("co_attention",), ("videocoattention_detection_f1",),
    ),
    "videocoatt_localization": (
        "videocoattention-vlm_localization", "box", ("bbox",), ("videocoattention_localization_iou",),
    ),
    "mustard_context": ("mustard-omni_video-context", "majority", ("sarcasm",), ("mustard_f1",)),
    "mustard_no_context": ("mustard-omni_video-no-context", "majority", ("sarcasm",), ("mustard_f1",)),
    "urfunny_context": ("urfunny-omni_video-context", "majority", ("funny",), ("urfunny_f1",)),
    "urfunny_audio": ("urfunny-omni_video-audio", "majority", ("funny",), ("urfunny_f1",)),
    "rldd": ("rldd-omni", "majority", ("label",), ("rldd_accuracy",)),
}
# A constant answer recalls one of six classes; this task has no training rows.
ANALYTIC = {("meview", "uar"): 1 / 6}


def baseline_report(truth: DataFrame) -> DataFrame:
    """Naive scores of all tasks: ``baseline_key, metric, value, n_used``.

    ``truth`` holds ``task, split, row_idx, messages`` with split ``train`` for
    what is learnt and anything else (one test split per task) for what is scored.
    """
    from tallyframe.functions import messages as ms
    from tallyframe.functions import parse as ps
    from tallyframe.metrics import registry as rg

    classes = {"contacts": rg.CONTACTS, "emotions": rg.EMOTION_CATEGORIES, "au12": rg.AU12, "au17": rg.AU17}
    spark = truth.sparkSession
    plan = {key: s for key, s in STRATEGIES.items()}
    lookup = F.create_map(*[F.lit(x) for key, (task, *_) in plan.items() for x in (task, key)])
    answers = truth.select(
        F.try_element_at(lookup, F.col("task")).alias("baseline_key"),
        F.when(F.col("split") == "train", True).otherwise(False).alias("training"),
        "row_idx",
        ms.answer_text(F.col("messages"), "first").alias("text"),
    ).where("baseline_key IS NOT NULL")
    parsed = once(once(answers).withColumn("gt", F.try_parse_json("text"))).where("gt IS NOT NULL")
    written = F.when(F.col("training"), F.col("text")).otherwise(F.to_json("gt")).alias("text")
    # Read by every strategy and every metric, each of them a few tasks of one split.
    kept = staged(parsed.select("baseline_key", "training", "row_idx", written), ["training", "baseline_key"])
    train = once(kept.where("training").select("baseline_key", "row_idx", F.try_parse_json("text").alias("gt")))
    test = kept.where("NOT training").select("baseline_key", "text")

    def of(strategy: str) -> dict[str, tuple]:
        return {k: s for k, s in plan.items() if s[1] == strategy}

    def pick(groups: dict[str, tuple]) -> Column:
        return F.col("baseline_key").isin(*groups) if groups else F.lit(False)

    # Majority: the most frequent JSON value of the answer key, for all such tasks at once.
    voting = of("majority")
    value = F.lit(None).cast("string")
    opening = F.lit(None).cast("string")
    for key, (_, _, (name,), _) in voting.items():
        value = F.when(F.col("baseline_key") == key, F.to_json(ps.field(F.col("gt"), name))).otherwise(value)
        opening = F.when(F.col("baseline_key") == key, F.lit(f'{{"{name}": ')).otherwise(opening)
    votes = train.where(pick(voting)).select("baseline_key", "row_idx", value.alias("v"))
    winners = majority_label(votes, ["baseline_key"], "v", seen="row_idx")
    learnt = winners.select("baseline_key", F.concat(opening, F.col("v"), F.lit("}")).alias("answer"))
    # Means of numbers, rounded by nobody.
    for key, (_, _, names, _) in of("mean").items():
        means = train.where(F.col("baseline_key") == key).agg(
            *[F.avg(F.try_variant_get("gt", f"$.{n}", "double")).alias(n) for n in names]
        )
        learnt = learnt.unionByName(
            means.select(F.lit(key).alias("baseline_key"), F.to_json(F.struct(*names)).alias("answer"))
        )
    for key, (_, strategy, (name, *_), _) in plan.items():
        kind, _, listed = strategy.partition(":")
        if kind == "frequent":
            sets = train.where(F.col("baseline_key") == key).select(
                F.coalesce(ps.as_list(ps.field(F.col("gt"), name)), F.array().cast("array<string>")).alias("gt")
            )
            often = frequent_labels(sets, [], classes[listed])
            learnt = learnt.unionByName(
                often.select(
                    F.lit(key).alias("baseline_key"), F.to_json(F.struct(F.col("pred").alias(name))).alias("answer")
                )
            )
    constant = F.lit(None).cast("string")
    for key, (_, strategy, (name, *_), _) in plan.items():
        kind, _, listed = strategy.partition(":")
        shown = {
            "all": lambda: F.to_json(F.struct(all_labels(classes[listed]).alias(name))),
            "point": lambda: F.to_json(F.struct(constant_point().alias(name))),
            "box": lambda: F.to_json(F.struct(constant_box().alias(name))),
            "one speaker": lambda: F.to_json(
                F.struct(single_speaker(ps.as_list(ps.field(F.col("gt"), name))).alias(name))
            ),
        }.get(kind)
        if shown:
            constant = F.when(F.col("baseline_key") == key, shown()).otherwise(constant)
    # One learnt answer per task: a table of at most as many rows as there are tasks.
    learnt = checkpoint(learnt)
    parsed = once(test.select("baseline_key", F.try_parse_json("text").alias("gt")))
    answered = parsed.join(F.broadcast(learnt), "baseline_key", "left")
    given = once(answered.select("baseline_key", "gt", F.coalesce("answer", constant).alias("pred"))).where("pred IS NOT NULL")
    rows = given.select("baseline_key", "gt", F.try_parse_json("pred").alias("pred"))
    # At most one row per task.
    tested = {r["baseline_key"] for r in test.select("baseline_key").distinct().collect()}
    known = {r["baseline_key"] for r in learnt.where("answer IS NOT NULL").select("baseline_key").collect()}
    fixed = {k for k, s in plan.items() if s[1].partition(":")[0] in ("all", "point", "box", "one speaker")}
    plan = {k: s for k, s in plan.items() if k in tested & (known | fixed)}
    report = spark.createDataFrame(
        [(k, m, v, 0) for (k, m), v in ANALYTIC.items()], "baseline_key string, metric string, value double, n_used long"
    )
    for metric in sorted({m for s in plan.values() for m in s[3]}):
        users = [k for k, s in plan.items() if metric in s[3]]
        report = report.unionByName(
            rg.run_metric(metric, rows.where(F.col("baseline_key").isin(*users)), ["baseline_key"])
        )
    return report
