"""Gaze targets and shared attention: GazeFollow, VideoAttentionTarget, VideoCoAttention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.geometry import box_convert, norm1000, norm_box
from tallyframe.functions.labels import index_to_time
from tallyframe.functions.messages import json_object, nested_list, number_list, numbered_people, quoted, truth
from tallyframe.operators.joins import absent_from, asof_next, gather, lookup_join
from tallyframe.operators.ordered import row_index
from tallyframe.operators.select import balance_negatives, first_per_group, greedy_min_distance, sample_n, shuffle_key
from tallyframe.recipes.common import box_line, existing, keep, samples

# Prompts.
GAZE_SYSTEM = (
    "You are an expert in gaze estimation. "
    "Given an image and the bounding box of a person's head, predict where they are looking. "
    "Bounding box coordinates are normalized to [0, 1000] in (x1, y1, x2, y2) format. "
    'Provide your answer as a valid JSON object: {"gaze_point": [x, y]}.'
)
TARGET_ANSWER = (
    "Coordinates are normalized to [0, 1000]. "
    'If the gaze target is within the frame provide: {"gaze_point": [x, y], "label": "gaze target"}. '
    'If the target is outside the frame provide: {"out_of_frame": true}.'
)
TARGET_SYSTEM = {
    "video": (
        "You are an expert in gaze target estimation in video. "
        "Given a video clip and the bounding box of a person's head, predict where they "
        "are looking at the specified timestamp. " + TARGET_ANSWER
    ),
    "frame": (
        "You are an expert in gaze target estimation. "
        "Given an image and the bounding box of a person's head, predict where they are looking. " + TARGET_ANSWER
    ),
}
SHARED_SYSTEM = {
    "detection": (
        "You are an expert in social scene understanding. "
        "Given an image and the bounding boxes of people in the scene, "
        "determine whether they share a common visual attention target. "
        "Provide your answer as a valid JSON object: "
        '{"co_attention": true} or {"co_attention": false}.'
    ),
    "localization": (
        "You are an expert in social scene understanding. "
        "Given an image and the bounding boxes of people sharing a visual attention target, "
        "locate the shared attention region. "
        "Bounding box coordinates are normalized to [0, 1000] in (x1, y1, x2, y2) format. "
        'Provide your answer as a valid JSON object: {"bbox": [x1, y1, x2, y2]}.'
    ),
}
SHARED_QUESTION = {
    "detection": "Are these people sharing a common visual attention target?",
    "localization": "Where is the shared visual attention target?",
}
SHARED_SIZE = (480, 320)
MIN_GAZE_DISTANCE = 25
SAMPLES_PER_SEQUENCE = 5

# Fields of the headerless annotation lines: position and type.
GAZE_FIELDS = {
    "path": (0, "string"), "idx": (1, "string"), "x": (2, "double"), "y": (3, "double"),
    "w": (4, "double"), "h": (5, "double"), "gaze_x": (8, "double"), "gaze_y": (9, "double"),
}
TARGET_FIELDS = {
    "frame": (0, "string"), "x1": (1, "int"), "y1": (2, "int"), "x2": (3, "int"), "y2": (4, "int"),
    "gx": (5, "int"), "gy": (6, "int"),
}


def _unit_point(x: Column, y: Column) -> Column:
    return F.array(norm1000(x, 1, "unit"), norm1000(y, 1, "unit"))


def _unit_box() -> Column:
    corners = box_convert(F.array("x", "y", "w", "h"), "xywh")
    return F.array(*[norm1000(corners[i], 1, "unit") for i in range(4)])


def gazefollow(lines: DataFrame, split: str, listing: DataFrame | None = None) -> DataFrame:
    """``lines``: GAZE_FIELDS and ``line_no``. Training has a row per line, validation one per person.

    Validation keeps all annotated points in line order and the first head box.
    """
    rows = existing(lines, listing, F.col("path"))
    if split == "train":
        rows = rows.withColumn("answer", json_object(gaze_point=number_list(_unit_point(F.col("gaze_x"), F.col("gaze_y")))))
        rows = rows.withColumns({"box": _unit_box(), "id": F.concat_ws("|", "path", "line_no")})
    else:
        rows = rows.withColumn("person", F.substring_index("idx", "-", 1))
        keys = ["path", "person"]
        heads = rows.groupBy(*keys).agg(F.min_by(_unit_box(), F.col("line_no")).alias("box"))
        points = gather(rows, keys, ["line_no"], _unit_point(F.col("gaze_x"), F.col("gaze_y")), "points")
        rows = points.join(heads, keys).withColumns(
            {
                "answer": json_object(gaze_points=nested_list(F.col("points"), number_list)),
                "id": F.concat_ws("|", *keys),
            }
        )
    user = F.concat(box_line("<image>\nPerson's head bounding box: ", F.col("box")), F.lit("\nWhere is this person looking?"))
    return samples(rows, "gazefollow", "gaze", split, F.col("id"), GAZE_SYSTEM, user, F.col("answer"), F.col("path"))


def videoattentiontarget(
    entries: DataFrame,
    sizes: DataFrame,
    variant: str,
    split: str,
    listing: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """``entries``: ``show, clip, seq, line_no`` and TARGET_FIELDS; ``sizes``: ``show, clip, width, height``.

    The frame variant keeps points at least 25 apart and at most one
    out-of-frame row per sequence, in line order and before looking for the
    file; the video variant takes five random rows of each sequence.
    """
    key = ["show", "clip", "seq"]
    w, h = F.col("width"), F.col("height")
    rows = row_index(entries, key, ["line_no"], "position")
    rows = keep(rows, lambda r: lookup_join(r, sizes, ["show", "clip"]), "unknown size")
    outside = (F.col("gx") == -1) & (F.col("gy") == -1)
    rows = rows.withColumns(
        {
            "box": norm_box(F.array("x1", "y1", "x2", "y2"), w, h),
            "px": norm1000(F.col("gx"), w),
            "py": norm1000(F.col("gy"), h),
            "outside": outside,
        }
    )
    head = box_line("Person head bounding box: ", F.col("box"))
    if variant == "video":
        rows = sample_n(rows, key, [*key, "line_no"], SAMPLES_PER_SEQUENCE, seed)
        media = F.concat_ws("/", "show", "clip")
        rows = existing(rows, listing, media)
        asked = F.concat(F.lit("\nAt t="), index_to_time(F.col("position")), F.lit("s, where is this person looking?"))
        user = F.concat(F.lit("<video>\n"), head, asked)
    else:
        apart = greedy_min_distance(rows.where(~outside), key, ["line_no"], ["px", "py"], MIN_GAZE_DISTANCE)
        once = first_per_group(rows.where(outside), key, [F.asc("line_no")])
        media = F.concat_ws("/", "show", "clip", "frame")
        rows = existing(apart.unionByName(once), listing, media)
        user = F.concat(F.lit("<image>\n"), head, F.lit("\nWhere is this person looking?"))
    point = json_object(gaze_point=number_list(F.array("px", "py")), label=quoted(F.lit("gaze target")))
    answer = F.when(F.col("outside"), json_object(out_of_frame=truth(F.lit(True)))).otherwise(point)
    sample_id = F.concat_ws("|", *key, "line_no")
    return samples(rows, "videoattentiontarget", variant, split, sample_id, TARGET_SYSTEM[variant], user, answer, media)


def videocoattention(
    events: DataFrame, frames: DataFrame, task: str, split: str, seed: int = 42, max_rows: int | None = None
) -> DataFrame:
    """``events``: ``video, frame, line_no, target, faces``; ``frames``: every stored ``video, frame, path``.

    Detection pairs each annotated frame with a random unannotated one of the
    same video, which borrows the faces of the next annotated frame.
    """
    boxes = F.transform("faces", lambda b: norm_box(b, *SHARED_SIZE, mode="round"))
    if task == "localization":
        rows = keep(events, lambda r: r.join(frames, ["video", "frame"]), "missing file")
        answer = json_object(bbox=number_list(norm_box(F.col("target"), *SHARED_SIZE, mode="round")))
        rows = rows.withColumns({"boxes": boxes, "answer": answer, "id": F.concat_ws("|", "video", "frame", "line_no")})
    else:
        first = first_per_group(events, ["video", "frame"], [F.asc("line_no")])
        positives = keep(first, lambda r: r.join(frames, ["video", "frame"]), "missing file").select("video", "frame", "path", "faces")
        bare = absent_from(frames, events, ["video", "frame"])
        chosen = balance_negatives(positives, bare, ["video"], ["video", "frame"], seed, max_rows)
        negatives = asof_next(
            chosen, events.select("video", "frame", "line_no", "faces"), ["video"], "frame", ["faces"], ["line_no"], max_rows
        ).select("video", "frame", "path", "faces")
        rows = positives.withColumn("shared", F.lit(True)).unionByName(negatives.withColumn("shared", F.lit(False)))
        rows = shuffle_key(rows, ["video", "frame"], seed).withColumns(
            {"boxes": boxes, "answer": json_object(co_attention=truth(F.col("shared"))), "id": F.concat_ws("|", "video", "frame")}
        )
    user = F.concat(
        F.lit("<image>\nThe following people are present in the image:\n"),
        numbered_people(F.col("boxes")),
        F.lit("\n" + SHARED_QUESTION[task]),
    )
    extra = ["shuffle_key"] if task == "detection" else []
    return samples(
        rows, "videocoattention", task, split, F.col("id"), SHARED_SYSTEM[task], user, F.col("answer"), F.col("path"), *extra
    )
