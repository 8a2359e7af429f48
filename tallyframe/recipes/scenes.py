"""People in images: EMOTIC, PISC, Proxemics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.geometry import box_convert, norm1000, norm_box, resolve_pair
from tallyframe.functions.labels import decode_label, onehot_to_labels, person_phrase
from tallyframe.functions.messages import (
    answer_by_split,
    json_object,
    keypoint_lines,
    nested_list,
    quoted,
    quoted_list,
)
from tallyframe.metrics.registry import CONTACTS, EMOTION_CATEGORIES
from tallyframe.operators.split import hash_split
from tallyframe.recipes.common import box_line, existing, keep, samples

# Prompts, labels and sizes.
EMOTION_SYSTEM = {
    "discrete": (
        "You are an expert in context-based emotion recognition. "
        "Given an image and the bounding box of a person, identify their emotional state "
        "from visual context, scene, and body language. "
        "Choose from: [" + ", ".join(EMOTION_CATEGORIES) + "]. "
        'Provide your answer as a valid JSON object: {"emotions": ["Emotion1", "Emotion2"]}. '
        "The list must contain at least one emotion."
    ),
    "vad": (
        "You are an expert in context-based emotion recognition. "
        "Given an image and the bounding box of a person, predict their emotional state "
        "as valence, arousal, and dominance scores. "
        "Each score is an integer from 1 (very low) to 9 (very high). "
        'Provide your answer as a valid JSON object: {"valence": x, "arousal": x, "dominance": x}.'
    ),
}
EMOTION_ASK = {"discrete": "What are the emotions of the ", "vad": "What are the valence, arousal, and dominance scores of the "}
RELATION_NAMES = {1: "Friends", 2: "Family", 3: "Couple", 4: "Professional", 5: "Commercial", 6: "No relation"}
RELATION_SYSTEM = (
    "You are a vision-language model specialized in social relationship recognition. "
    "Given an image and the bounding boxes of two individuals, classify their fine-grained "
    'social relationship into one of: ["Friends", "Family", "Couple", "Professional", '
    '"Commercial", "No relation"]. Provide your answer as a valid JSON string.'
)
CONTACT_SYSTEM = (
    "You are an expert in analyzing physical contact between people. "
    "Given an image of two individuals and their body information, identify which body "
    "parts are touching between them. Choose from: "
    '["Hand touch hand", "Hand touch shoulder", "Shoulder touch shoulder", '
    '"Hand touch elbow", "Elbow touch shoulder", "Hand touch torso"]. '
    "Provide your answer as a valid JSON string with a list of touching body part pairs. "
    "The list may be empty if no body parts are touching."
)
CONTACT_SIZE = 224
KEYPOINTS = [
    "Left Head", "Right Head", "Left Shoulder", "Right Shoulder", "Left Elbow",
    "Right Elbow", "Left Hand", "Right Hand", "Left Torso", "Right Torso",
]

PERSON = (
    "array<struct<body_bbox:array<int>,gender:string,age:string,categories:array<array<string>>,"
    "continuous:array<struct<valence:double,arousal:double,dominance:double>>>>"
)


def _vad_text(v: Column) -> Column:
    whole = lambda c: c.cast("int").cast("string")
    return json_object(valence=whole(v["valence"]), arousal=whole(v["arousal"]), dominance=whole(v["dominance"]))


def emotic(images: DataFrame, task: str, split: str, listing: DataFrame | None = None) -> DataFrame:
    """``images``: ``folder, filename, width, height, person`` (type PERSON).

    Training takes the first annotator, the other splits all annotators that answered.
    """
    path = F.concat_ws("/", "folder", "filename")
    rows = existing(images, listing, path).select(
        path.alias("path"), "width", "height", F.posexplode("person").alias("j", "p")
    )
    if task == "discrete":
        given = F.filter("p.categories", lambda a: F.size(a) > 0)
        first = F.get("p.categories", F.lit(0))
        first = F.when(F.size(first) > 0, first)
        single = json_object(emotions=quoted_list(first))
        every = json_object(emotions_per_annotator=nested_list(given, quoted_list))
    else:
        complete = lambda a: ~(
            F.isnan(a["valence"]) | F.isnan(a["arousal"]) | F.isnan(a["dominance"])
            | a["valence"].isNull() | a["arousal"].isNull() | a["dominance"].isNull()
        )
        given = F.filter("p.continuous", complete)
        first = F.get("p.continuous", F.lit(0))
        first = F.when(complete(first), first)
        single = _vad_text(first)
        every = json_object(vad_per_annotator=nested_list(given, _vad_text))
    enough = first.isNotNull() if split == "train" else F.size(given) > 0
    rows = keep(rows, enough, "no annotation")
    user = F.concat(
        box_line("<image>\nBounding box: ", norm_box(F.col("p.body_bbox"), F.col("width"), F.col("height"))),
        F.lit("\n" + EMOTION_ASK[task]),
        person_phrase(F.col("p.gender"), F.col("p.age")),
        F.lit(" in this bounding box?"),
    )
    answer = answer_by_split(F.lit(split), single, every)
    sample_id = F.concat_ws("|", "path", "j")
    return samples(rows, "emotic", task, split, sample_id, EMOTION_SYSTEM[task], user, answer, F.col("path"))


def pisc(
    images: DataFrame, relations: DataFrame, ids: DataFrame, split: str, listing: DataFrame | None = None
) -> DataFrame:
    """``images``: ``id, width, height, boxes``; ``relations``: ``id, pairs`` map of ``"i j"`` to label; ``ids``: ``id``."""
    path = F.format_string("%05d.jpg", F.col("id").cast("int"))
    rows = keep(ids, lambda r: r.join(images, "id"), "unknown image")
    rows = keep(rows, lambda r: r.join(relations, "id"), "no relation")
    rows = existing(rows, listing, path)
    boxes = F.transform("boxes", lambda b: norm_box(b, F.col("width"), F.col("height"), "round"))
    rows = rows.select("id", path.alias("path"), boxes.alias("boxes"), F.explode("pairs").alias("pair", "label"))
    rows = keep(rows.withColumn("two", resolve_pair(F.col("pair"), F.col("boxes"))), F.col("two").isNotNull(), "unknown person")
    user = F.concat(
        F.lit("<image>\nTwo individuals are visible in this image.\n"),
        box_line("Person 1 bounding box: ", F.col("two")[0]),
        box_line("\nPerson 2 bounding box: ", F.col("two")[1]),
        F.lit("\nWhat is the social relationship between Person 1 and Person 2?"),
    )
    answer = json_object(relationship=quoted(decode_label(F.col("label"), RELATION_NAMES)))
    sample_id = F.concat_ws("|", "id", "pair")
    return samples(rows, "pisc", "relation", split, sample_id, RELATION_SYSTEM, user, answer, F.col("path"))


def proxemics(
    labels: DataFrame, boxes: DataFrame, skeleton: bool, listing: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """``labels``: ``path, contacts, points0, points1``; ``boxes``: ``path, p0, p1`` as ymin, ymax, xmin, xmax.

    Split 80/20 over the images that have both.
    """
    both = keep(labels, lambda r: r.join(boxes, "path"), "no boxes")
    rows = existing(hash_split(both, "path", 0.8, seed), listing, F.col("path"))

    def grid(value: Column) -> Column:
        return norm1000(value, CONTACT_SIZE, "round")

    def person(column: str) -> Column:
        corners = box_convert(F.col(column), "yyxx")
        return F.array(*[grid(corners[i]) for i in range(4)])

    lines = [
        F.lit("<image>\nHere are the bounding boxes of the 2 persons:\n"),
        box_line("Person 1 bounding box: ", person("p0")),
        box_line("\nPerson 2 bounding box: ", person("p1")),
    ]
    if skeleton:
        at = lambda p: F.array(grid(p[0]), grid(p[1]))
        for i in (0, 1):
            lines += [F.lit("\n\n"), keypoint_lines(f"Person {i + 1} skeleton:", F.col(f"points{i}"), KEYPOINTS, at)]
    lines.append(F.lit("\n\nEvaluate which body parts are touching between Person 1 and Person 2."))
    answer = json_object(touching=quoted_list(onehot_to_labels(F.col("contacts"), CONTACTS)))
    task = "skeleton" if skeleton else "no_skeleton"
    return samples(
        rows, "proxemics", task, F.col("split"), F.col("path"), CONTACT_SYSTEM, F.concat(*lines), answer, F.col("path")
    )
