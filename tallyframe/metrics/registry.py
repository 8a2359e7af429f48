"""Named metrics over parsed answers.

A metric reads ``pairs`` with the VARIANT columns ``gt`` and ``pred`` (and
``head`` for gaze) and returns ``by..., metric, value, n_used``. ``needs`` marks
rows a metric cannot read: by default they are dropped and show in ``n_used``;
with ``strict`` one such row replaces the whole metric of its group by
``<name>_error``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import labels as lb
from tallyframe.functions import parse as ps
from tallyframe.functions.binding import once, strip
from tallyframe.metrics import localization as loc
from tallyframe.metrics.classification import classification_report
from tallyframe.metrics.common import NAN, key_of
from tallyframe.metrics.diarization import PARTS, diarization_error
from tallyframe.metrics.multilabel import exact_match, mean_jaccard, multilabel_report
from tallyframe.metrics.ranking import average_precision, roc_auc
from tallyframe.metrics.regression import aae, ccc, count_mae

# The class lists of the tasks.
AU12 = ["AU1", "AU2", "AU4", "AU6", "AU7", "AU10", "AU12", "AU15", "AU23", "AU24", "AU25", "AU26"]
AU17 = [
    "AU1", "AU2", "AU4", "AU5", "AU6", "AU7", "AU9", "AU10", "AU12",
    "AU14", "AU15", "AU17", "AU20", "AU23", "AU24", "AU25", "AU26",
]
EXPRESSIONS = ["Neutral", "Anger", "Disgust", "Fear", "Happiness", "Sadness", "Surprise", "Other"]
EMOTION_CATEGORIES = [
    "Affection", "Anger", "Annoyance", "Anticipation", "Aversion", "Confidence", "Disapproval",
    "Disconnection", "Disquietment", "Doubt/Confusion", "Embarrassment", "Engagement", "Esteem",
    "Excitement", "Fatigue", "Fear", "Happiness", "Pain", "Peace", "Pleasure", "Sadness",
    "Sensitivity", "Suffering", "Surprise", "Sympathy", "Yearning",
]
DIALOGUE_EMOTIONS = ["Anger", "Disgust", "Fear", "Joy", "Neutral", "Sadness", "Surprise"]
CONCEALED_EMOTIONS = ["anger", "contempt", "disgust", "fear", "happy", "surprise"]
MICRO_EMOTIONS = ["happiness", "surprise", "disgust", "fear", "sadness", "anger", "others"]
MACRO_EMOTIONS = ["anger", "disgust", "fear", "happiness", "sadness", "surprise"]
SPEECH_EMOTIONS = [
    "Neutral", "Happiness", "Anger", "Sadness", "Surprise", "Fear", "Disgust", "Contempt", "Other",
]
RELATIONS = ["Friends", "Family", "Couple", "Professional", "Commercial", "No relation"]
CONTACTS = [
    "Hand touch hand", "Hand touch shoulder", "Shoulder touch shoulder",
    "Hand touch elbow", "Elbow touch shoulder", "Hand touch torso",
]
HONESTY = ["deceptive", "truthful"]
VOCAL_SOUNDS = ["Laughter", "Sigh", "Cough", "Throat clearing", "Sneeze", "Sniff"]
VAD = ["valence", "arousal", "dominance"]


@dataclass(frozen=True)
class Metric:
    compute: Callable[[DataFrame, list[str]], DataFrame]
    needs: Column | Callable[[], Column] | None = None
    empty: dict[str, float] = field(default_factory=dict)


def _g(key: str) -> Column:
    return ps.field(F.col("gt"), key)


def _p(key: str) -> Column:
    return ps.field(F.col("pred"), key)


def _text(value: Column) -> Column:
    return ps.as_text(value)


def _pairs(rows: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    return rows.select(*by, *[c.alias(n) for n, c in columns.items()])


def _empty_list() -> Column:
    return F.array().cast("array<string>")


def _labels(rows: DataFrame, by: list[str], gt: Column, pred: Column, **options) -> DataFrame:
    return classification_report(_pairs(rows, by, gt=gt, pred=pred), by, **options)


# Label sets -----------------------------------------------------------------


def _unit_f1(classes: list[str]):
    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        units = lambda side: F.coalesce(ps.as_list(side("action_units")), _empty_list())
        pairs = _pairs(rows, by, gt=units(_g), pred=units(_p))
        return multilabel_report(pairs, by, classes, ["f1"], {"f1": "macro_au_f1"}, lower=False)

    return compute


def _annotated_emotions() -> Column:
    per_annotator = F.try_variant_get("gt", "$.emotions_per_annotator", "array<array<string>>")
    return F.coalesce(lb.annotator_union(per_annotator), F.array_distinct(ps.as_list(_g("emotions"))))


def _emotion_sets(rows: DataFrame, by: list[str]) -> DataFrame:
    pred = F.coalesce(F.array_distinct(ps.as_list(_p("emotions"))), _empty_list())
    return _pairs(rows, by, gt=_annotated_emotions(), pred=pred)


def _emotion_ap(rows: DataFrame, by: list[str]) -> DataFrame:
    return multilabel_report(_emotion_sets(rows, by), by, EMOTION_CATEGORIES, ["ap", "f1"], {"ap": "mAP"})


def _emotion_jaccard(rows: DataFrame, by: list[str]) -> DataFrame:
    return mean_jaccard(_emotion_sets(rows, by), by)


def _touching(side: str) -> Column:
    return ps.flatten_labels(ps.alias_get(F.col(side), "touching", "touching_body_parts"))


def _contact_sets(rows: DataFrame, by: list[str]) -> DataFrame:
    return _pairs(rows, by, gt=_touching("gt"), pred=_touching("pred"))


def _contact_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    pairs = _contact_sets(rows, by)
    return exact_match(pairs, by, CONTACTS).unionByName(multilabel_report(pairs, by, CONTACTS, ["acc"]))


def _contact_map(rows: DataFrame, by: list[str]) -> DataFrame:
    return multilabel_report(_contact_sets(rows, by), by, CONTACTS, ["ap", "f1"], {"ap": "mAP"})


# Single labels --------------------------------------------------------------


def _expression_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    pred = F.coalesce(_text(_p("label")), F.lit(""))
    return _labels(rows, by, _text(_g("label")), pred, outputs=["macro_f1"], classes=EXPRESSIONS, per_class=["f1"])


def _dialogue_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    title = lambda v: ps.coerce_label(v, "Neutral")
    return _labels(
        rows, by, title(_g("emotion")), title(_p("emotion")),
        outputs=["weighted_f1", "macro_f1"], classes=DIALOGUE_EMOTIONS, per_class=["f1"],
    )


def _concealed_uar(rows: DataFrame, by: list[str]) -> DataFrame:
    low = lambda v: F.lower(F.coalesce(_text(v), F.lit("")))
    return _labels(
        rows, by, low(_g("emotion")), low(_p("emotion")),
        outputs=["accuracy", "macro_f1", "uar"], classes=CONCEALED_EMOTIONS, per_class=["f1"],
    )


def _micro_emotion(rows: DataFrame, by: list[str]) -> DataFrame:
    """Seven classes where the ground truth of a group has ``others``, else six."""
    pairs = _pairs(rows, by, gt=_text(_g("emotion")), pred=_text(_p("emotion")))
    wide = pairs.where("gt = 'others'").select(*by).distinct() if by else pairs.where("gt = 'others'")
    options = {"outputs": ["accuracy", "macro_f1", "uar"], "per_class": ["f1"]}
    if not by:
        micro = not wide.isEmpty()
        return classification_report(pairs, by, classes=MICRO_EMOTIONS if micro else MACRO_EMOTIONS, **options)
    seven = classification_report(pairs.join(wide, by, "left_semi"), by, classes=MICRO_EMOTIONS, **options)
    six = classification_report(pairs.join(wide, by, "left_anti"), by, classes=MACRO_EMOTIONS, **options)
    return seven.unionByName(six)


def _speech_truth(by_class: bool) -> Column:
    votes = ps.as_list(_g("emotions_per_annotator"))
    if by_class:
        titled = F.transform(votes, lambda v: F.initcap(v))
        return lb.annotator_vote(titled, SPEECH_EMOTIONS, "Neutral")
    return F.coalesce(lb.annotator_vote(votes), _text(_g("emotion")))


def _speech_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(
        rows, by, _speech_truth(True), ps.coerce_label(_p("emotion")),
        outputs=["weighted_f1", "macro_f1"], classes=SPEECH_EMOTIONS, per_class=["f1"],
    )


def _speech_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(rows, by, _speech_truth(False), _text(_p("emotion")), outputs=["ua", "wa"])


def _speech_weighted(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(rows, by, _speech_truth(False), _text(_p("emotion")), outputs=["weighted_f1"])


def _sarcasm(rows: DataFrame, by: list[str]) -> DataFrame:
    whole = lambda v: ps.coerce_int(v).cast("string")
    outputs = ["accuracy", "weighted_f1", "macro_f1", "precision", "recall"]
    return _labels(rows, by, whole(_g("sarcasm")), whole(_p("sarcasm")), outputs=outputs)


def _relation(side: str) -> Column:
    if side == "gt":
        return _text(_g("relationship"))
    return _text(ps.alias_get(F.col("pred"), "relationship", "social_relationship"))


def _relation_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(rows, by, _relation("gt"), _relation("pred"), outputs=["accuracy", "macro_f1"], classes=RELATIONS)


def _relation_map(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(
        rows, by, _relation("gt"), _relation("pred"),
        outputs=["mAP"], classes=RELATIONS, per_class=["ap", "recall", "f1"], skip_absent=True,
    )


def _honesty(rows: DataFrame, by: list[str]) -> DataFrame:
    return _labels(
        rows, by, _text(_g("label")), _text(_p("label")),
        outputs=["accuracy", "macro_f1"], classes=HONESTY, per_class=["f1"],
    )


def _humor(rows: DataFrame, by: list[str]) -> DataFrame:
    flag = lambda v: ps.coerce_binary(v).cast("string")
    pairs = _pairs(rows, by, gt=flag(_g("funny")), pred=flag(_p("funny")))
    scores = classification_report(pairs, by, outputs=["accuracy", "macro_f1"])
    single = classification_report(
        pairs, by, outputs=[], classes=["1", "0"], per_class=["f1"], names={"1": "funny", "0": "not_funny"}
    )
    return scores.unionByName(single)


def _joint_attention(rows: DataFrame, by: list[str]) -> DataFrame:
    whole = lambda v: ps.coerce_int(v).cast("string")
    outputs = ["accuracy", "f1", "precision", "recall"]
    return _labels(rows, by, whole(_g("co_attention")), whole(_p("co_attention")), outputs=outputs)


def _vocal(side: str) -> Column:
    chosen = ps.alias_get(F.col(side), "vocal_sound", "sound", "Vocal Sound", "class")
    return F.coalesce(_text(chosen), F.lit(""))


def _vocal_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    pairs = _pairs(rows, by, gt=_vocal("gt"), pred=_vocal("pred"))
    overall = classification_report(pairs, by, outputs=["accuracy", "macro_f1"])
    return overall.unionByName(
        classification_report(pairs, by, outputs=[], classes=VOCAL_SOUNDS, per_class=["f1"])
    )


# Numbers --------------------------------------------------------------------


def _float(side: Callable[[str], Column], key: str) -> Column:
    value = side(key)
    text = F.when(ps.is_text(value), strip(_text(value)).try_cast("double"))
    return F.coalesce(text, F.try_variant_get(value, "$", "double"))


def _annotator_dims(empty: float | None) -> dict[str, Column]:
    items = F.try_variant_get("gt", "$.vad_per_annotator", "array<variant>")

    def mean(dim: str) -> Column:
        values = F.transform(items, lambda a: F.try_variant_get(a, f"$.{dim}", "double"))
        return lb.annotator_mean(F.coalesce(values, F.array().cast("array<double>")), empty)

    return {d: mean(d) for d in VAD}


def _first_failure_stops(dims: list[str], pred: dict[str, Column], gt: dict[str, Column]) -> dict[str, Column]:
    """A row that fails at one dimension still counts for the dimensions before it."""
    out, ok = {}, F.lit(True)
    for d in dims:
        ok = ok & pred[d].isNotNull() & gt[d].isNotNull()
        out[d] = F.when(ok, pred[d])
    return out


def _row_aae(order: list[str]):
    def compute(rows: DataFrame, by: list[str]) -> DataFrame:
        means = _annotator_dims(None)
        gt = {d: F.coalesce(means[d], _float(_g, d)) for d in order}
        whole = gt[order[0]].isNotNull() & gt[order[1]].isNotNull() & gt[order[2]].isNotNull()
        pred = {d: F.when(whole, _float(_p, d)) for d in order}
        kept = _first_failure_stops(order, pred, gt)
        columns = {f"gt_{d}": gt[d] for d in order} | {f"pred_{d}": kept[d] for d in order}
        return aae(_pairs(rows, by, **columns), by, order)

    return compute


def _va_ccc(rows: DataFrame, by: list[str]) -> DataFrame:
    dims = ["valence", "arousal"]
    columns = {f"gt_{d}": _float(_g, d) for d in dims} | {f"pred_{d}": _float(_p, d) for d in dims}
    return ccc(_pairs(rows, by, **columns), by, dims)


def _speech_ccc(rows: DataFrame, by: list[str]) -> DataFrame:
    order = ["arousal", "valence", "dominance"]
    means = _annotator_dims(0.0)
    columns = {f"gt_{d}": means[d] for d in order} | {f"pred_{d}": ps.coerce_number(_p(d)) for d in order}
    return ccc(_pairs(rows, by, **columns), by, order)


def _speaker_count(rows: DataFrame, by: list[str]) -> DataFrame:
    whole = lambda side: ps.coerce_int(side("num_speakers"))
    return count_mae(_pairs(rows, by, gt=whole(_g), pred=whole(_p)), by)


# Ranking --------------------------------------------------------------------


def _honesty_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    hard = F.when(_text(_p("label")) == "deceptive", 1.0).otherwise(0.0)
    score = F.coalesce(_float(_p, "confidence"), hard)
    return roc_auc(_pairs(rows, by, gt=(_text(_g("label")) == "deceptive").cast("int"), score=score), by)


def _outside(side: Callable[[str], Column]) -> Column:
    value = F.to_json(side("out_of_frame"))
    return F.when(value.isNull() | value.isin("false", "0", '""', "[]", "{}"), 0).otherwise(1)


def _outside_ap(rows: DataFrame, by: list[str]) -> DataFrame:
    score = F.coalesce(_float(_p, "out_of_frame_score"), _outside(_p).cast("double"))
    pairs = _pairs(rows, by, gt=_outside(_g), pred=_outside(_p), score=score)
    ap = average_precision(pairs, by, "out_of_frame_ap")
    labels = pairs.select(*by, F.col("gt").cast("string").alias("gt"), F.col("pred").cast("string").alias("pred"))
    f1 = classification_report(labels, by, outputs=[], classes=["1"], per_class=["f1"], skip_absent=True)
    undefined = ap.where(F.isnan("value")).withColumn("metric", F.lit("out_of_frame_f1"))
    return ap.unionByName(f1.withColumn("metric", F.lit("out_of_frame_f1"))).unionByName(undefined)


# Points, boxes, timelines -----------------------------------------------------


def _numbers(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<double>")


def _annotated_points() -> Column:
    many = F.try_variant_get("gt", "$.gaze_points", "array<array<double>>")
    return F.coalesce(many, F.array(_numbers(_g("gaze_point"))))


def _gaze(rows: DataFrame, by: list[str], metric) -> DataFrame:
    head = F.col("head") if "head" in rows.columns else F.lit(None).cast("array<double>")
    point = _numbers(_p("gaze_point"))
    pairs = _pairs(rows, by, gt=_annotated_points(), pred=point, head=head)
    return metric(pairs.where(F.size("pred") >= 2), by)


def _gaze_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    return loc.heatmap_auc(_pairs(rows, by, gt=_annotated_points(), pred=_numbers(_p("gaze_point"))), by)


def _target_distance(rows: DataFrame, by: list[str]) -> DataFrame:
    inside = rows.where((_outside(_g) == 0) & (_outside(_p) == 0))
    pairs = _pairs(inside, by, gt=_numbers(_g("gaze_point")), pred=_numbers(_p("gaze_point")))
    return loc.in_frame_distance(pairs, by)


def _box_overlap(rows: DataFrame, by: list[str]) -> DataFrame:
    return loc.box_overlap(_pairs(rows, by, gt=_numbers(_g("bbox")), pred=_numbers(_p("bbox"))), by)


def _timeline(side: Callable[[str], Column]) -> Column:
    return ps.as_list(side("timeline"))


def _der(rows: DataFrame, by: list[str]) -> DataFrame:
    return diarization_error(_pairs(rows, by, gt=_timeline(_g), pred=_timeline(_p)), by)


def _both(key: str) -> Callable[[], Column]:
    return lambda: _g(key).isNotNull() & _p(key).isNotNull()


def _undefined(*names: str) -> dict[str, float]:
    return {n: NAN for n in names}


def _box_given() -> Column:
    return (F.size(_numbers(_g("bbox"))) == 4) & (F.size(_numbers(_p("bbox"))) == 4)


def _all_floats(dims: list[str]) -> Callable[[], Column]:
    def ok() -> Column:
        result = F.lit(True)
        for d in dims:
            result = result & _float(_g, d).isNotNull() & _float(_p, d).isNotNull()
        return result

    return ok


def _annotated_or_given(dims: list[str]) -> Callable[[], Column]:
    def ok() -> Column:
        result = F.lit(True)
        for d in dims:
            given = ps.has_key(F.col("gt"), "vad_per_annotator") | _float(_g, d).isNotNull()
            result = result & given & F.try_variant_get(_p(d), "$", "double").isNotNull()
        return result

    return ok


METRICS: dict[str, Metric] = {
    "affwild2_au_f1": Metric(_unit_f1(AU12), empty=_undefined("macro_au_f1")),
    "affwild2_expr_f1": Metric(_expression_f1, lambda: ps.has_key(F.col("gt"), "label"), {"macro_f1": 0.0}),
    "affwild2_va_ccc": Metric(_va_ccc, _all_floats(["valence", "arousal"])),
    "emotic_discrete_ap": Metric(_emotion_ap, lambda: _annotated_emotions().isNotNull()),
    "emotic_discrete_jaccard": Metric(
        _emotion_jaccard, lambda: _annotated_emotions().isNotNull() & ps.as_list(_p("emotions")).isNotNull()
    ),
    "emotic_vad_aae": Metric(
        _row_aae(VAD), empty=_undefined("aae_valence", "aae_arousal", "aae_dominance", "aae_mean")
    ),
    "gazefollow_angular_error": Metric(
        lambda rows, by: _gaze(rows, by, loc.gaze_angle), empty={"min_angular_error": 0.0, "avg_angular_error": 0.0}
    ),
    "gazefollow_auc": Metric(_gaze_auc, lambda: _annotated_points()[0].isNotNull(), _undefined("auc")),
    "gazefollow_distance": Metric(
        lambda rows, by: _gaze(rows, by, loc.gaze_distance), empty={"min_dist": 0.0, "avg_dist": 0.0}
    ),
    "meld_weighted_f1": Metric(_dialogue_f1),
    "meview_uar": Metric(_concealed_uar),
    "mmew_au_f1": Metric(_unit_f1(AU17), _both("action_units"), _undefined("macro_au_f1")),
    "mmew_emotion_accuracy": Metric(_micro_emotion, _both("emotion")),
    "msppodcast_labels_accuracy": Metric(
        _speech_accuracy, lambda: _speech_truth(False).isNotNull() & _p("emotion").isNotNull()
    ),
    "msppodcast_labels_f1": Metric(
        _speech_f1,
        lambda: ps.coerce_label(_p("emotion")).isNotNull(),
        _undefined("weighted_f1", "macro_f1", *[f"f1_{key_of(c)}" for c in SPEECH_EMOTIONS]),
    ),
    "msppodcast_labels_weighted_f1": Metric(
        _speech_weighted, lambda: _speech_truth(False).isNotNull() & _p("emotion").isNotNull()
    ),
    "msppodcast_vad_aae": Metric(
        _row_aae(["arousal", "valence", "dominance"]), _annotated_or_given(["arousal", "valence", "dominance"])
    ),
    "msppodcast_vad_ccc": Metric(
        _speech_ccc,
        lambda: ps.coerce_number(_p("arousal")).isNotNull()
        & ps.coerce_number(_p("valence")).isNotNull()
        & ps.coerce_number(_p("dominance")).isNotNull(),
        _undefined("ccc_arousal", "ccc_valence", "ccc_dominance", "ccc_mean"),
    ),
    "mustard_f1": Metric(
        _sarcasm,
        lambda: ps.coerce_int(_g("sarcasm")).isNotNull() & ps.coerce_int(_p("sarcasm")).isNotNull(),
        {"accuracy": 0.0, "weighted_f1": 0.0, "macro_f1": 0.0, "precision": 0.0, "recall": 0.0},
    ),
    "pisc_accuracy": Metric(
        _relation_accuracy, lambda: _relation("pred").isNotNull(), _undefined("accuracy", "macro_f1")
    ),
    "pisc_map": Metric(_relation_map),
    "proxemics_accuracy": Metric(
        _contact_accuracy,
        lambda: _touching("gt").isNotNull() & _touching("pred").isNotNull(),
        _undefined("exact_match_accuracy"),
    ),
    "proxemics_map": Metric(
        _contact_map, lambda: _touching("gt").isNotNull() & _touching("pred").isNotNull(), _undefined("mAP")
    ),
    "rldd_accuracy": Metric(_honesty, _both("label")),
    "rldd_auc": Metric(
        _honesty_auc,
        lambda: _g("label").isNotNull() & (_p("confidence").isNotNull() | _p("label").isNotNull()),
        _undefined("auc"),
    ),
    "urfunny_f1": Metric(
        _humor,
        lambda: ps.coerce_binary(_g("funny")).isNotNull() & ps.coerce_binary(_p("funny")).isNotNull(),
        _undefined("accuracy", "macro_f1", "f1_funny", "f1_not_funny"),
    ),
    "videoattentiontarget_distance": Metric(_target_distance, empty=_undefined("dist")),
    "videoattentiontarget_out_of_frame_ap": Metric(_outside_ap),
    "videocoattention_detection_f1": Metric(
        _joint_attention,
        lambda: ps.coerce_int(_g("co_attention")).isNotNull() & ps.coerce_int(_p("co_attention")).isNotNull(),
        _undefined("accuracy", "f1", "precision", "recall"),
    ),
    "videocoattention_localization_iou": Metric(_box_overlap, _box_given, _undefined("mean_iou", "l2_dist")),
    "vocalsound_accuracy": Metric(_vocal_accuracy),
    "voxconverse_der": Metric(
        _der, lambda: _timeline(_g).isNotNull() & _timeline(_p).isNotNull(), _undefined(*PARTS)
    ),
    "voxconverse_speaker_count_mae": Metric(
        _speaker_count,
        lambda: ps.coerce_int(_g("num_speakers")).isNotNull() & ps.coerce_int(_p("num_speakers")).isNotNull(),
        _undefined("mae", "exact_accuracy"),
    ),
}

# Metrics whose result tells how many rows it used; for the others a dropped row means an error.
COUNTS_ROWS = {
    "emotic_vad_aae", "msppodcast_labels_f1", "msppodcast_vad_ccc", "pisc_accuracy", "proxemics_accuracy",
    "proxemics_map", "urfunny_f1", "videoattentiontarget_distance", "videocoattention_detection_f1",
    "videocoattention_localization_iou", "voxconverse_speaker_count_mae",
}
# Metrics that skip unreadable rows by their own rules, so strict scoring does not apply.
SKIPS_ROWS = COUNTS_ROWS | {"affwild2_expr_f1", "mustard_f1", "voxconverse_der", "gazefollow_auc"}


def register_metric(name: str, metric: Metric) -> None:
    """Add a user metric under a new name."""
    if name in METRICS:
        raise ValueError(f"metric {name} exists")
    METRICS[name] = metric


def run_metric(name: str, rows: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """Score the groups of ``rows``; groups without any readable row get the empty values."""
    spec = METRICS[name]
    needs = spec.needs() if callable(spec.needs) else spec.needs
    ok = F.coalesce(needs, F.lit(False)) if needs is not None else F.lit(True)
    # Parsed once: answers are mentioned many times here.
    parsed = once(rows)
    result = spec.compute(parsed.where(ok) if needs is not None else parsed, by)
    if spec.empty and by:
        # Joined with all groups, so that the scores are planned once.
        groups = rows.select(*[F.col(b).alias(f"__{b}") for b in by]).distinct()
        same = reduce(lambda a, b: a & b, [groups[f"__{b}"].eqNullSafe(result[b]) for b in by])
        none = F.lit(0).cast("long").alias("n_used")
        cells = [F.struct(F.lit(m).alias("metric"), F.lit(float(v)).alias("value"), none) for m, v in spec.empty.items()]
        given = F.array(F.struct("metric", "value", "n_used"))
        filled = F.inline(F.when(F.col("metric").isNull(), F.array(*cells)).otherwise(given))
        result = groups.join(result, same, "left").select(*[F.col(f"__{b}").alias(b) for b in by], filled)
    if strict and needs is not None and name not in SKIPS_ROWS and by:
        broken = parsed.where(~ok).select(*by).distinct()
        error = broken.select(
            *by,
            F.lit(f"{name}_error").alias("metric"),
            F.lit(None).cast("double").alias("value"),
            F.lit(0).cast("long").alias("n_used"),
        )
        result = result.join(broken, by, "left_anti").unionByName(error)
    return result
