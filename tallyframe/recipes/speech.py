"""Speech and dialogue: MELD, MUStARD, UR-FUNNY, RLDD, VocalSound, MSP-Podcast, VoxConverse."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.geometry import norm1000
from tallyframe.functions.labels import decode_label, fold_prefix
from tallyframe.functions.messages import (
    answer_by_split,
    box_text,
    dialogue_lines,
    json_object,
    nested_list,
    number3,
    quoted,
    quoted_list,
    truth,
)
from tallyframe.metrics.registry import DIALOGUE_EMOTIONS, SPEECH_EMOTIONS, VOCAL_SOUNDS
from tallyframe.operators.intervals import bin_timeline
from tallyframe.operators.joins import first_match, gather, present_in
from tallyframe.operators.split import hash_split, split_filter
from tallyframe.recipes.common import existing, keep, samples

# Prompts, labels and codes.
DIALOGUE_SYSTEM = {
    "video_audio": (
        "You are an expert in multimodal emotion recognition. "
        "Given a video clip and an audio recording of a speaker in a conversation, "
        f"classify their emotion into one of: {json.dumps(DIALOGUE_EMOTIONS)}. "
        'Provide your answer as a valid JSON object: {"emotion": "Category"}.'
    ),
    "audio_only": (
        "You are an expert in emotion recognition from speech. "
        "Given an audio recording of a speaker in a conversation, "
        f"classify their emotion into one of: {json.dumps(DIALOGUE_EMOTIONS)}. "
        'Provide your answer as a valid JSON object: {"emotion": "Category"}.'
    ),
    "video_transcript": (
        "You are an expert in multimodal emotion recognition. "
        "Given a video clip of a speaker and the transcript of what they said, "
        f"classify their emotion into one of: {json.dumps(DIALOGUE_EMOTIONS)}. "
        'Provide your answer as a valid JSON object: {"emotion": "Category"}.'
    ),
}
SARCASM_ANSWER = 'Provide your answer as a valid JSON object: {"sarcasm": true} or {"sarcasm": false}.'
SARCASM_SYSTEM = {
    "video_no_context": (
        "You are an expert at detecting sarcasm in multimodal communication. "
        "Given a video clip and audio recording of a speaker, determine whether "
        "their utterance is sarcastic. " + SARCASM_ANSWER
    ),
    "video_context": (
        "You are an expert at detecting sarcasm in multimodal communication. "
        "Given a video clip and audio recording of a speaker, along with the preceding "
        "dialogue context, determine whether their utterance is sarcastic. " + SARCASM_ANSWER
    ),
}
HUMOR_ANSWER = 'Provide your answer as a valid JSON object: {"funny": 1} or {"funny": 0}.'
HUMOR_SYSTEM = {
    "video_audio": (
        "You are an expert at detecting humor in video. "
        "Given a video clip and audio recording of a speaker delivering a punchline, "
        "determine whether it is funny. " + HUMOR_ANSWER
    ),
    "video_context": (
        "You are an expert at detecting humor in video. "
        "Given a video clip and audio recording of a speaker delivering a punchline, "
        "along with the preceding context sentences, determine whether it is funny. " + HUMOR_ANSWER
    ),
}
HONESTY_SYSTEM = (
    "You are an expert at detecting deception in video. "
    "Given a video clip and audio recording of a person, determine whether "
    "they are being deceptive or truthful. "
    'Provide your answer as a valid JSON object: {"label": "deceptive"} or {"label": "truthful"}.'
)
HONESTY_USER = "<video>\nIs this person being deceptive or truthful?"
VOCAL_CODES = {
    "/m/01j3sz": "Laughter",
    "/m/07plz5l": "Sigh",
    "/m/01b_21": "Cough",
    "/m/0dl9sf8": "Throat clearing",
    "/m/01hsr_": "Sneeze",
    "/m/07ppn3j": "Sniff",
}
VOCAL_SYSTEM = (
    "You are an expert in vocal sound recognition. "
    "Given an audio clip of a person producing a vocal sound, "
    "classify it into one of the following categories: "
    f"{json.dumps(VOCAL_SOUNDS)}. "
    "Provide your answer as a valid JSON string."
)
VOCAL_USER = (
    "<audio>\n"
    "For this given audio, identify the vocal sound and give the corresponding class "
    f"out of the following: {json.dumps(VOCAL_SOUNDS)}."
)
EMOTION_CODES = {
    "N": "Neutral", "H": "Happiness", "A": "Anger", "S": "Sadness", "U": "Surprise",
    "F": "Fear", "D": "Disgust", "C": "Contempt", "O": "Other",
}
PODCAST_SPLITS = {"Train": "train", "Development": "validation", "Test1": "test", "Test2": "test"}
PODCAST_SYSTEM = {
    "labels": (
        "You are an expert in speech emotion recognition. "
        "Given an audio clip of a speaker, classify their emotional state. "
        f"Choose from: {json.dumps(SPEECH_EMOTIONS)}. "
        'Provide your answer as a valid JSON object: {"emotion": "Neutral"}.'
    ),
    "vad": (
        "You are an expert in speech emotion recognition. "
        "Given an audio clip of a speaker, predict their emotional state "
        "as arousal, valence, and dominance scores. "
        "Each score is a float from 1 (very low) to 7 (very high). "
        'Provide your answer as a valid JSON object: {"arousal": x.x, "valence": x.x, "dominance": x.x}.'
    ),
}
PODCAST_USER = {
    "labels": "<audio>\nWhat is the emotional state of the speaker in this audio clip?",
    "vad": "<audio>\nWhat are the arousal, valence, and dominance scores of the speaker in this audio clip?",
}
DIARIZATION_SYSTEM = {
    "diarization": (
        "You are an expert in speaker diarization. "
        "Given a 30-second audio clip, identify who speaks in each 0.5-second bin. "
        "Assign each distinct speaker a letter (A, B, C, ...) in order of first appearance. "
        "Use '-' for silence and combined letters (e.g. 'AB') for simultaneous speech. "
        "Provide your answer as a valid JSON object with exactly 60 entries: "
        '{"timeline": ["A", "A", "AB", "B", "-", ...]}.'
    ),
    "speaker_count": (
        "You are an expert in speaker diarization. "
        "Given a 30-second audio clip, count the number of distinct speakers present. "
        'Provide your answer as a valid JSON object: {"num_speakers": N}.'
    ),
}
DIARIZATION_USER = {
    "diarization": (
        "<audio>\n"
        "For each of the 60 half-second bins in this clip, indicate which speaker(s) "
        "are active. Use letters (A, B, ...) in order of first appearance, '-' for silence, "
        "combined letters (e.g. 'AB') for overlap."
    ),
    "speaker_count": "<audio>\nHow many distinct speakers are present in this 30-second clip?",
}


def prefer_corrected(df: DataFrame, corrected: str, original: str) -> Column:
    """The corrected id when that column exists, else the original; unreadable ids are NULL."""
    name = corrected if corrected in df.columns else original
    return F.col(f"`{name}`").try_cast("int")


def meld(
    utterances: DataFrame, modality: str, split: str, videos: DataFrame, audios: DataFrame, faces: DataFrame
) -> DataFrame:
    """``utterances``: the CSV columns; ``videos``: ``dialogue, utterance, path, total_frames, width, height``.

    ``audios``: ``dialogue, utterance, path``; ``faces``: ``dialogue, utterance,
    frame, line_no, x1, y1, x2, y2``. The box is that of the middle frame.
    """
    key = ["dialogue", "utterance"]
    given = utterances.select(
        prefer_corrected(utterances, "Corrected Dialogue_ID", "Dialogue_ID").alias("dialogue"),
        prefer_corrected(utterances, "Corrected Utterance_ID", "Utterance_ID").alias("utterance"),
        F.col("Emotion").alias("emotion"),
        F.col("Utterance").alias("said"),
    )
    rows = keep(given, F.col("dialogue").isNotNull() & F.col("utterance").isNotNull(), "bad id")
    if modality != "video_transcript":
        rows = keep(rows, lambda r: r.join(audios.select(*key, F.col("path").alias("audio")), key), "missing audio")
    if modality == "audio_only":
        user, media = F.lit("<audio>\nWhat is the emotion of the speaker?"), F.col("audio")
    else:
        rows = keep(rows, lambda r: r.join(videos, key), "missing video").withColumn(
            "frame", F.when(F.col("total_frames") > 0, F.floor(F.col("total_frames") / 2).cast("int"))
        )
        boxes = faces.select(*key, "frame", "line_no", "x1", "y1", "x2", "y2")
        rows = first_match(rows, boxes, [*key, "frame"], ["line_no"])
        box = F.array(
            *[norm1000(F.col(c), F.col("height" if c[0] == "y" else "width"), "truncate") for c in ("x1", "y1", "x2", "y2")]
        )
        face = F.concat(F.lit("Speaker face bounding box: "), box_text(box), F.lit("\n"))
        line = F.when(F.col("x1").isNotNull(), face).otherwise("")
        said = F.concat(F.lit('Transcript: "'), F.col("said"), F.lit('"\n'))
        middle = F.lit("<audio>\n") if modality == "video_audio" else said
        user = F.concat(F.lit("<video>\n"), line, middle, F.lit("What is the emotion of the speaker?"))
        media = F.col("path")
    answer = json_object(emotion=quoted(F.col("emotion")))
    sample_id = F.concat_ws("|", *key)
    return samples(rows, "meld", modality, split, sample_id, DIALOGUE_SYSTEM[modality], user, answer, media)


def mustard(entries: DataFrame, modality: str, listing: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``entries``: ``key, sarcasm, context, context_speakers``; split 80/20 over all keys."""
    media = F.concat(F.col("key"), F.lit(".mp4"))
    rows = existing(hash_split(entries, "key", 0.8, seed), listing, media)
    context = F.concat(
        F.lit("Dialogue context:\n"), dialogue_lines(F.col("context"), F.col("context_speakers")), F.lit("\n")
    )
    middle = context if modality == "video_context" else F.lit("")
    user = F.concat(F.lit("<video>\n"), middle, F.lit("Is the speaker being sarcastic?"))
    answer = json_object(sarcasm=truth(F.col("sarcasm")))
    return samples(
        rows, "mustard", modality, F.col("split"), F.col("key"), SARCASM_SYSTEM[modality], user, answer, media
    )


def urfunny(
    folds: DataFrame, labels: DataFrame, language: DataFrame, modality: str, listing: DataFrame | None = None
) -> DataFrame:
    """``folds``: ``split, id``; ``labels``: ``id, funny``; ``language``: ``id, context_sentences``."""
    media = F.concat(F.col("id").cast("string"), F.lit(".mp4"))
    rows = keep(existing(folds, listing, media), lambda r: r.join(labels, "id"), "no label").join(language, "id", "left")
    sentences = F.coalesce("context_sentences", F.array().cast("array<string>"))
    context = F.concat(F.lit("Context:\n"), dialogue_lines(sentences), F.lit("\n"))
    middle = context if modality == "video_context" else F.lit("")
    user = F.concat(F.lit("<video>\n"), middle, F.lit("Is the punchline funny?"))
    answer = json_object(funny=F.col("funny").cast("string"))
    return samples(rows, "urfunny", modality, F.col("split"), F.col("id"), HUMOR_SYSTEM[modality], user, answer, media)


def rldd(listing: DataFrame, seed: int = 42) -> DataFrame:
    """``listing``: ``path`` of clips; the label is the folder name in lower case."""
    folder = F.lower(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    clips = keep(listing.select("path", folder.alias("label")), F.col("path").endswith(".mp4"), "no video")
    clips = keep(clips, F.col("label").isin("deceptive", "truthful"), "unknown folder")
    rows = hash_split(clips, "path", 0.8, seed)
    answer = json_object(label=quoted(F.col("label")))
    return samples(
        rows, "rldd", "deception", F.col("split"), F.col("path"), HONESTY_SYSTEM, HONESTY_USER, answer, F.col("path")
    )


def vocalsound(entries: DataFrame, split: str, listing: DataFrame | None = None) -> DataFrame:
    """``entries``: ``wav, labels``; only the file name of ``wav`` counts. Unknown codes are dropped."""
    rows = entries.select(F.substring_index("wav", "/", -1).alias("path"), decode_label(F.col("labels"), VOCAL_CODES).alias("sound"))
    rows = existing(keep(rows, F.col("sound").isNotNull(), "unknown label"), listing, F.col("path"))
    answer = json_object(vocal_sound=quoted(F.col("sound")))
    return samples(rows, "vocalsound", "sound", split, F.col("path"), VOCAL_SYSTEM, VOCAL_USER, answer, F.col("path"))


def msppodcast(consensus: DataFrame, detailed: DataFrame, task: str, listing: DataFrame | None = None) -> DataFrame:
    """``consensus``: ``file, emotion, arousal, valence, dominance, split_set``; ``detailed``: the same per annotator with ``line_no``.

    Training answers are the consensus; the others list all annotators that gave
    every number. Rows of the hidden test set are dropped.
    """
    scores = ["arousal", "valence", "dominance"]
    known = keep(consensus, lambda r: split_filter(r, F.col("split_set"), PODCAST_SPLITS), "hidden split")
    rows = known.withColumn("agreed", decode_label(F.col("emotion"), EMOTION_CODES))
    whole = detailed.dropna(subset=scores).withColumn("emotion", fold_prefix(F.col("emotion"), "other", "Other"))
    votes = gather(whole, ["file"], ["line_no"], F.struct("emotion", *scores), "votes")
    train = rows.where("split = 'train'")
    if task == "labels":
        train = keep(train, F.col("agreed").isNotNull(), "no agreement")
    listed = keep(rows.where("split <> 'train'"), lambda r: r.join(votes, "file"), "no annotator")
    rows = train.unionByName(listed, allowMissingColumns=True)
    rows = existing(rows, listing, F.col("file"))
    if task == "labels":
        single = json_object(emotion=quoted(F.col("agreed")))
        every = json_object(emotions_per_annotator=quoted_list(F.transform("votes", lambda v: v["emotion"])))
    else:
        single = json_object(**{s: number3(F.col(s)) for s in scores})
        every = json_object(
            vad_per_annotator=nested_list(
                F.col("votes"), lambda v: json_object(**{s: v[s].cast("double").cast("string") for s in scores})
            )
        )
    answer = answer_by_split(F.col("split"), single, every)
    return samples(
        rows, "msppodcast", task, F.col("split"), F.col("file"), PODCAST_SYSTEM[task], PODCAST_USER[task], answer, F.col("file")
    )


def voxconverse(
    segments: DataFrame, clips: DataFrame, task: str, split: str, windows: DataFrame | None = None
) -> DataFrame:
    """``segments``: ``clip, seq, start, end, speaker``; ``clips``: ``clip, duration``; ``windows``: cut audio ``path``."""
    rows = bin_timeline(keep(segments, lambda r: present_in(r, clips, ["clip"]), "unknown clip"), clips)
    media = F.concat_ws("_", "clip", "win_start", (F.col("win_start") + 30).cast("string"))
    rows = existing(rows, windows, media)
    if task == "diarization":
        answer = json_object(timeline=quoted_list(F.col("timeline")))
    else:
        answer = json_object(num_speakers=F.col("num_speakers").cast("string"))
    rows = rows.withColumns({"clip_id": F.col("clip").cast("string"), "m": media, "start": F.col("win_start").cast("float")})
    made = samples(
        rows, "voxconverse", task, split, F.col("m"), DIARIZATION_SYSTEM[task], DIARIZATION_USER[task], answer, F.col("m"),
        "clip_id", "start",
    )
    return made.withColumnRenamed("start", "win_start")
