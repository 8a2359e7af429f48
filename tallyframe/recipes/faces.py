"""Facial behaviour: AffWild2, MMEW, MEVIEW."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.binding import strip
from tallyframe.functions.labels import decode_index, decode_label, onehot_to_labels, parse_units, units_phrase
from tallyframe.functions.messages import json_object, number3, quoted, quoted_list, reasoning_block
from tallyframe.metrics.registry import AU12, EXPRESSIONS, MACRO_EMOTIONS, MICRO_EMOTIONS
from tallyframe.operators.joins import present_in
from tallyframe.operators.select import cap_per_label, dedupe_exact, greedy_min_distance, no_sentinel, no_sentinel_in
from tallyframe.operators.split import borrow_last, common_keys, subject_split
from tallyframe.operators.windows import sample_frames_with_anchor, sliding_frames, window_bounds
from tallyframe.recipes.common import existing, keep, samples

# Prompts and limits.
FRAME_SYSTEM = {
    "expr": (
        "You are an expert in facial expression recognition. "
        "Given a 16-frame video clip, predict the facial expression at the center frame. "
        f"Classify into one of: {json.dumps(EXPRESSIONS)}. "
        'Provide your answer as a valid JSON object: {"label": "Expression"}.'
    ),
    "va": (
        "You are an expert in affective computing. "
        "Given a 16-frame video clip, predict the valence and arousal at the center frame. "
        "Both values are continuous in [-1, 1]. "
        'Provide your answer as a valid JSON object: {"valence": x.xxx, "arousal": x.xxx}.'
    ),
    "au": (
        "You are an expert in facial action unit detection. "
        "Given a 16-frame video clip, predict which action units are active at the center frame. "
        f"Possible action units: {json.dumps(AU12)}. "
        'Provide your answer as a valid JSON object: {"action_units": ["AU1", ...]} '
        'or {"action_units": []} if none are active.'
    ),
    "expr_think": (
        "You are an expert in facial expression recognition and affective computing. "
        "Given a 16-frame video clip, analyze the center frame: first provide the valence/arousal "
        "and active action units inside <think> tags, then classify the facial expression. "
        f"Expression must be one of: {json.dumps(EXPRESSIONS)}. "
        "Use the format:\n"
        "<think>\n"
        '{"valence": x.xxx, "arousal": x.xxx}\n'
        '{"action_units": ["AU1", ...]}\n'
        "</think>\n"
        '{"label": "Expression"}'
    ),
}
FRAME_USER = {
    "expr": "<video>\nWhat is the facial expression at the center frame of this clip?",
    "va": "<video>\nWhat are the valence and arousal values at the center frame of this clip?",
    "au": "<video>\nWhich action units are active at the center frame of this clip?",
    "expr_think": (
        "<video>\nFor the center frame of this clip, provide the valence/arousal and "
        "active action units, then give the expression label."
    ),
}
MAX_PER_EXPRESSION = 5
MIN_AFFECT_DISTANCE = 0.05
BORROWED = 20

UNITS_SYSTEM = (
    "You are an expert in facial action unit analysis. "
    "Given an apex frame of a micro-expression, identify the active facial action units. "
    'Provide your answer as a valid JSON object: {"action_units": ["AU6", "AU12"]} '
    'or {"action_units": []} if none are active.'
)
APEX_SYSTEM = (
    "You are an expert in facial expression recognition. "
    f"Given a face image, classify the emotion into one of: {json.dumps(MICRO_EMOTIONS)}. "
    'Provide your answer as a valid JSON object: {"emotion": "happiness"}.'
)
CLIP_SYSTEM = (
    "You are an expert in micro-expression recognition. "
    "Given a video clip of a face, classify the micro-expression emotion into one of: "
    f"{json.dumps(MICRO_EMOTIONS)}. "
    'Provide your answer as a valid JSON object: {"emotion": "happiness"}.'
)
SPOTTING = (
    "1. Apex Spotting: The movement begins from a neutral state (Onset), reaches its maximum "
    "muscular intensity during the sequence (Apex), and then fades (Offset).\n"
)
UNITS_LINE = "2. Action Units: At the peak intensity (Apex), the activated Action Units are "
DEDUCTION = (
    "3. Deduction: The dynamic activation of these specific Action Units is a physical "
    "signature characteristic of "
)
CLIP_THINK_SYSTEM = (
    "You are an expert in micro-expression recognition. "
    "Given a video clip of a face, reason step by step inside <think> tags: spot the apex "
    "frame, identify the active action units, and deduce the emotion. Then output the final "
    f"answer. The emotion must be one of: {json.dumps(MICRO_EMOTIONS)}. "
    "Use the format:\n"
    "<think>\n" + SPOTTING + UNITS_LINE + "<AUs>.\n" + DEDUCTION + '<emotion>.\n</think>\n{"emotion": "<emotion>"}'
)
MICRO_USER = {
    "apex_au": "<image>\nWhich facial action units are active in this apex frame?",
    "apex_emotion": "<image>\nWhat emotion is expressed in this face image?",
    "clip_emotion": "<video>\nWhat micro-expression emotion is shown in this clip?",
    "clip_emotion_think": "<video>\nWhat micro-expression emotion is shown in this clip?",
}
SUBJECTS = {"train": (1, 24), "val": (25, 30)}
MIN_FRAMES = 4

CONCEALED_LABELS = ["contempt", "disgust", "surprise", "happy", "anger", "fear"]
CONCEALED_SYSTEM = (
    "You are an expert in micro-expression recognition. "
    "Micro-expressions are brief, involuntary facial expressions lasting less than "
    "half a second that reveal suppressed or concealed emotions. "
    "Given a short video clip of a person's face, identify the concealed emotion. "
    f"Choose from: {json.dumps(CONCEALED_LABELS)}. "
    'Provide your answer as a valid JSON object: {"emotion": "..."}.'
)
CONCEALED_USER = "<video>\nWhat concealed emotion is shown in this micro-expression clip?"
CONCEALED_NAMES = {
    "contempt": "contempt",
    "contempt/disgust": "disgust",
    "disgust": "disgust",
    "surprise": "surprise",
    "happy": "happy",
    "happiness": "happy",
    "anger": "anger",
    "fear": "fear",
}


def _valid(task: str, value: Column) -> Column:
    if task == "expr":
        return no_sentinel(value)
    if task == "va":
        return value[0].between(-1, 1) & value[1].between(-1, 1)
    return no_sentinel_in(value)


def _answer(task: str, value: Column) -> Column:
    if task == "expr":
        return json_object(label=quoted(decode_index(value, EXPRESSIONS)))
    if task == "va":
        return json_object(valence=number3(value[0]), arousal=number3(value[1]))
    return json_object(action_units=quoted_list(onehot_to_labels(value, AU12)))


def affwild2(
    frames: DataFrame,
    task: str,
    split: str,
    videos: DataFrame,
    clips: DataFrame | None = None,
    stride: int = 16,
) -> DataFrame:
    """``frames``: ``clip, frame, value`` of one annotation kind; ``videos``: ``clip``; ``clips``: cut windows ``path``.

    Rows without a cut window leave before the diversity filters, which only
    count windows that were produced.
    """
    media = F.concat_ws("_", "clip", "start")
    rows = sliding_frames(keep(frames, lambda r: present_in(r, videos, ["clip"]), "missing video"), ["clip"], stride=stride)
    rows = existing(keep(rows, _valid(task, F.col("value")), "invalid annotation"), clips, media)
    if task == "expr":
        rows = cap_per_label(rows, ["clip"], "value", ["frame"], MAX_PER_EXPRESSION)
    elif task == "va":
        points = rows.withColumns({"v": F.col("value")[0], "a": F.col("value")[1]})
        rows = greedy_min_distance(points, ["clip"], ["frame"], ["v", "a"], MIN_AFFECT_DISTANCE)
    else:
        rows = dedupe_exact(rows, ["clip"], "value", ["frame"])
    return samples(
        rows, "affwild2", task, split, media, FRAME_SYSTEM[task], FRAME_USER[task], _answer(task, F.col("value")), media
    )


def affwild2_think(
    kinds: dict[str, dict[str, DataFrame]], videos: DataFrame, clips: DataFrame | None = None, stride: int = 16
) -> DataFrame:
    """Reasoned answers for clips annotated in all three kinds; ``kinds[kind][split]`` as in ``affwild2``.

    The last twenty training clips move to validation.
    """
    common = {s: common_keys([kinds[k][s].select("clip") for k in ("expr", "va", "au")], "clip") for s in ("train", "val")}
    splits = borrow_last(common["train"], common["val"], "clip", BORROWED)

    def of(kind: str, name: str) -> DataFrame:
        both = kinds[kind]["train"].unionByName(absent(kinds[kind]["val"], kinds[kind]["train"]))
        return both.select("clip", "frame", F.col("value").alias(name))

    def absent(val: DataFrame, train: DataFrame) -> DataFrame:
        return val.join(train.select("clip").distinct(), "clip", "left_anti")

    rows = of("expr", "e").join(of("va", "va"), ["clip", "frame"]).join(of("au", "au"), ["clip", "frame"])
    rows = keep(rows, lambda r: present_in(r, videos, ["clip"]), "missing video")
    rows = sliding_frames(rows, ["clip"], stride=stride).join(splits, "clip")
    media = F.concat_ws("_", "clip", "start")
    ok = _valid("expr", F.col("e")) & _valid("va", F.col("va")) & _valid("au", F.col("au"))
    rows = cap_per_label(existing(keep(rows, ok, "invalid annotation"), clips, media), ["clip"], "e", ["frame"], MAX_PER_EXPRESSION)
    content = F.concat(_answer("va", F.col("va")), F.lit("\n"), _answer("au", F.col("au")))
    answer = reasoning_block(content, _answer("expr", F.col("e")))
    task = "expr_think"
    return samples(rows, "affwild2", task, F.col("split"), media, FRAME_SYSTEM[task], FRAME_USER[task], answer, media)


def mmew(
    sheet: DataFrame, task: str, frames: DataFrame, stills: DataFrame | None = None
) -> DataFrame:
    """``sheet``: ``subject, filename, onset, apex, offset, au_raw, emotion``; ``frames``: ``filename, number, path``.

    ``stills``: ``subject, emotion, path`` of posed faces, used by ``apex_emotion``.

    Where ``frames`` has an ``emotion`` too, a file name is looked up below its emotion only.
    """
    key = [c for c in ("emotion", "filename") if c in frames.columns]
    given = keep(sheet, F.col("subject").isNotNull() & F.col("emotion").isNotNull(), "incomplete row")
    rows = subject_split(given.withColumn("emotion", strip(F.col("emotion"))), "subject", SUBJECTS)
    emotion = json_object(emotion=quoted(F.col("emotion")))
    if task.startswith("apex"):
        apex = frames.select(*key, F.col("number").alias("apex"), "path")
        rows = keep(rows, lambda r: r.join(apex, [*key, "apex"]), "missing apex frame")
        if task == "apex_emotion" and stills is not None:
            posed = subject_split(stills.where(F.col("emotion").isin(MACRO_EMOTIONS)), "subject", SUBJECTS)
            rows = rows.unionByName(posed, allowMissingColumns=True)
        answer = emotion if task == "apex_emotion" else json_object(action_units=quoted_list(parse_units(F.col("au_raw"))))
        system = APEX_SYSTEM if task == "apex_emotion" else UNITS_SYSTEM
        return samples(rows, "mmew", task, F.col("split"), F.col("path"), system, MICRO_USER[task], answer, F.col("path"))
    wanted = sample_frames_with_anchor(F.col("onset"), F.col("apex"), F.col("offset"))
    # Frames are counted for each marked span: two sheet rows of one file do not add up.
    span = [*key, "onset", "apex", "offset"]
    stored = rows.select(*span).distinct().withColumn("number", F.explode(wanted)).join(frames, [*key, "number"], "left_semi")
    enough = stored.groupBy(*span).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= MIN_FRAMES)
    rows = keep(rows, lambda r: r.join(enough, span), "too few frames")
    if task == "clip_emotion_think":
        story = F.concat(
            F.lit(SPOTTING + UNITS_LINE), units_phrase(F.col("au_raw")), F.lit(".\n" + DEDUCTION), F.col("emotion"), F.lit(".")
        )
        answer, system = reasoning_block(story, emotion), CLIP_THINK_SYSTEM
    else:
        answer, system = emotion, CLIP_SYSTEM
    return samples(rows, "mmew", task, F.col("split"), F.col("filename"), system, MICRO_USER[task], answer, F.col("filename"))


def meview(sheet: DataFrame, clips: DataFrame) -> DataFrame:
    """``sheet``: ``subject, clip_id, onset, offset, emotion``; ``clips``: ``path, total_frames``.

    Adds the padded frame range and its seconds for the cutter.
    """
    known = sheet.withColumn("emotion", decode_label(F.lower(strip(F.col("emotion"))), CONCEALED_NAMES))
    whole = F.col("subject").isNotNull() & F.col("clip_id").isNotNull() & F.col("onset").isNotNull() & F.col("offset").isNotNull()
    rows = keep(keep(known, whole, "incomplete row"), F.col("emotion").isNotNull(), "unknown emotion").withColumn(
        "path", F.format_string("sub%02d-%d.mp4", F.col("subject").cast("int"), F.col("clip_id").cast("int"))
    )
    rows = keep(rows, lambda r: r.join(clips, "path"), "missing file")
    rows = rows.withColumns(window_bounds(F.col("onset"), F.col("offset"), F.col("total_frames")))
    answer = json_object(emotion=quoted(F.col("emotion")))
    sample_id = F.concat_ws("|", "path", "onset")
    return samples(
        rows, "meview", "recognition", "test", sample_id, CONCEALED_SYSTEM, CONCEALED_USER, answer, F.col("path"),
        "start_sec", "end_sec",
    )
