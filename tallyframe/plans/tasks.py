"""The scored tasks: where their truth lives and which metrics apply."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    folder: str
    metrics: tuple[str, ...]
    baseline: str
    prefix: str | None = None
    split_alias: dict[str, str] = field(default_factory=dict)
    needs_head: bool = False
    #: SQL function (text) -> JSON text or NULL for responses without a JSON answer; with ``text_classes`` it is made
    #: here, otherwise it is one that the user has registered.
    text_parser: str | None = None
    text_classes: tuple[str, ...] = ()
    text_key: str = ""


_VAL = {"test": "val"}

# Task keys as they occur in the names of prediction files, the folders of the
# built tables, the metric names and the keys of the naive baselines.
TASKS: dict[str, Task] = {
    "gazefollow-vlm": Task(
        "gazefollow",
        ("gazefollow_distance", "gazefollow_auc", "gazefollow_angular_error"),
        "gazefollow",
        prefix="gazefollow",
        split_alias={"test": "validation", "val": "validation"},
        needs_head=True,
    ),
    "vat-omni_video": Task(
        "videoattentiontarget/video",
        ("videoattentiontarget_distance", "videoattentiontarget_out_of_frame_ap"),
        "vat_video",
        prefix="vat_video",
    ),
    "vat-omni_frame": Task(
        "videoattentiontarget/frame",
        ("videoattentiontarget_distance", "videoattentiontarget_out_of_frame_ap"),
        "vat_frame",
        prefix="vat_frame",
    ),
    "videocoattention-vlm_detection": Task(
        "videocoattention/detection", ("videocoattention_detection_f1",), "videocoatt_detection"
    ),
    "videocoattention-vlm_localization": Task(
        "videocoattention/localization", ("videocoattention_localization_iou",), "videocoatt_localization"
    ),
    "meld-omni_video-audio": Task("meld/video_audio", ("meld_weighted_f1",), "meld_video_audio"),
    "meld-omni_audio-only": Task("meld/audio_only", ("meld_weighted_f1",), "meld_audio_only"),
    "meld-omni_video-transcript": Task("meld/video_transcript", ("meld_weighted_f1",), "meld_video_transcript"),
    "affwild2-omni_expr": Task(
        "affwild2/expr", ("affwild2_expr_f1",), "affwild2_expr", prefix="affwild2_expr", split_alias=_VAL
    ),
    "affwild2-omni_expr-think": Task(
        "affwild2/expr", ("affwild2_expr_f1",), "affwild2_expr", prefix="affwild2_expr_think", split_alias=_VAL
    ),
    "affwild2-omni_va": Task("affwild2/va", ("affwild2_va_ccc",), "affwild2_va", split_alias=_VAL),
    "affwild2-omni_au": Task("affwild2/au", ("affwild2_au_f1",), "affwild2_au", split_alias=_VAL),
    "mmew_apex-au": Task("mmew/apex_au", ("mmew_au_f1",), "mmew_au", split_alias=_VAL),
    "mmew_apex-emotion": Task(
        "mmew/apex_emotion", ("mmew_emotion_accuracy",), "mmew_apex_emotion", split_alias=_VAL
    ),
    "mmew_clip-emotion": Task(
        "mmew/clip_emotion", ("mmew_emotion_accuracy",), "mmew_clip_emotion", split_alias=_VAL
    ),
    "mmew_clip-emotion-think": Task(
        "mmew/clip_emotion_think", ("mmew_emotion_accuracy",), "mmew_clip_emotion", split_alias=_VAL
    ),
    "emotic-vlm_discrete": Task(
        "emotic/discrete",
        ("emotic_discrete_ap", "emotic_discrete_jaccard"),
        "emotic_discrete",
        prefix="emotic_discrete",
    ),
    "emotic-vlm_vad": Task("emotic/vad", ("emotic_vad_aae",), "emotic_vad", prefix="emotic_vad"),
    "pisc-vlm": Task("pisc", ("pisc_accuracy", "pisc_map"), "pisc"),
    "proxemics-vlm_no-skeleton": Task(
        "proxemics/no_skeleton", ("proxemics_accuracy", "proxemics_map"), "proxemics_no_skel"
    ),
    "proxemics-vlm_skeleton": Task(
        "proxemics/skeleton", ("proxemics_accuracy", "proxemics_map"), "proxemics_skel"
    ),
    "mustard-omni_video-no-context": Task("mustard/video_no_context", ("mustard_f1",), "mustard_no_context"),
    "mustard-omni_video-context": Task("mustard/video_context", ("mustard_f1",), "mustard_context"),
    "urfunny-omni_video-audio": Task("urfunny/video_audio", ("urfunny_f1",), "urfunny_audio"),
    "urfunny-omni_video-context": Task("urfunny/video_context", ("urfunny_f1",), "urfunny_context"),
    "rldd-omni": Task("rldd", ("rldd_accuracy", "rldd_auc"), "rldd"),
    "vocalsound-omni": Task("vocalsound", ("vocalsound_accuracy",), "vocalsound"),
    "voxconverse-omni_diarization": Task("voxconverse/diarization", ("voxconverse_der",), "voxconverse_diar"),
    "voxconverse-omni_speaker-count": Task(
        "voxconverse/speaker", ("voxconverse_speaker_count_mae",), "voxconverse_speaker"
    ),
    "msppodcast-omni_labels": Task(
        "msppodcast/labels", ("msppodcast_labels_f1",), "msppodcast_labels", prefix="msppodcast_labels"
    ),
    "msppodcast-omni_vad": Task(
        "msppodcast/vad", ("msppodcast_vad_ccc",), "msppodcast_vad", prefix="msppodcast_vad"
    ),
    "meview-omni": Task(
        "meview",
        ("meview_uar",),
        "meview",
        prefix="meview_recognition",
        text_parser="concealed_emotion_of",
        text_classes=("anger", "contempt", "disgust", "fear", "happy", "surprise"),
        text_key="emotion",
    ),
}

# Split names that may end the name of a prediction file.
SPLITS = ["train", "test", "val", "validation", "dev"]


def register_text_parser(spark: SparkSession, name: str, classes: list[str] | tuple[str, ...], key: str) -> None:
    """Make the SQL function ``name``: a JSON object with the last quoted class word of a text, else the last bare one.

    It is a temporary function of the session that any query may call; plans contain its expression, not a call.
    """
    words = "|".join(classes)
    found = [f"regexp_extract_all(response, r'{pattern}', 1)" for pattern in (rf"(?i)[\x22\x27]({words})[\x22\x27]", rf"(?i)\b({words})\b")]
    last = "lower(coalesce(" + ", ".join(f"try_element_at({f}, -1)" for f in found) + "))"
    body = f"CASE WHEN {last} IS NOT NULL THEN to_json(named_struct('{key}', {last})) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(response STRING) RETURNS STRING RETURN {body}")


def ensure_text_parsers(spark: SparkSession, tasks: dict[str, Task]) -> None:
    """Make the parsers of the tasks that are described by classes; those already in the session stay as they are."""
    for key, task in tasks.items():
        if task.text_parser and not spark.catalog.functionExists(task.text_parser):
            if not task.text_classes:
                raise ValueError(f"{key}: no function {task.text_parser} in this session")
            register_text_parser(spark, task.text_parser, task.text_classes, task.text_key)


def parse_source_name(path: Column) -> tuple[Column, Column]:
    """Task key and split of ``PRED_{key}_{split}.jsonl``; without a known split it is ``test``."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    stem = F.regexp_replace(stem, r"^PRED_", "")
    last = F.regexp_extract(stem, rf"_({'|'.join(SPLITS)})$", 1)
    found = last != ""
    key = F.when(found, F.substring(stem, F.lit(1), F.char_length(stem) - F.char_length(last) - 1)).otherwise(stem)
    return key, F.when(found, last).otherwise("test")


def resolve_split(task: Column, split: Column) -> Column:
    """The split that holds the truth of a task."""
    table = [(f"{k}|{a}", b) for k, t in TASKS.items() for a, b in t.split_alias.items()]
    literal = F.create_map(*[F.lit(x) for pair in table for x in pair])
    return F.coalesce(F.try_element_at(literal, F.concat_ws("|", task, split)), split)


def task_table(spark) -> DataFrame:
    """The registry as a small table."""
    rows = [(k, t.folder, t.prefix, list(t.metrics), t.baseline) for k, t in TASKS.items()]
    return spark.createDataFrame(
        rows, "task string, folder string, prefix string, metrics array<string>, baseline_key string"
    )
