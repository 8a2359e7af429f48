"""Small documents with every awkward case, and plain helpers."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("contamination", T.LongType()),
])
WORDS = [a + b for a in ("ba", "Ko", "ri", "tü", "ße", "mo") for b in ("lan", "Ver", "x", "do.", "é", "sun,", "a1")]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t "]) for _ in range(n)).strip()


def rows(seed: int = 0, n: int = 120) -> list[tuple]:
    """Near and exact copies, a group of a third of all rows, nulls, empty and very long texts, a repeated row."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    texts = [None, "", " \n\t ", "one two", "one two", "short", prose(rng, 20_000), base]
    while len(texts) < n:
        kind = len(texts) % 6
        if kind in (0, 1):
            texts.append(base)
        elif kind == 2:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append(prose(rng, rng.randrange(1, 150)))
    sources = [None, "", "a", "b", "Z", "é"]
    out = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(sources), len(t or ""), "clash", "clash", i) for i, t in enumerate(texts)]
    return [*out, out[9], (None, "no id here at all, only some words", "en", "a", 1, None, None, None)]


def table(spark, data: list[tuple]):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower(text or "")).split(" ") if w]
