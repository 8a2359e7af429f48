"""The JVM shortcut and the Python decoder must agree on every response."""

from __future__ import annotations

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import messages as ms
from tallyframe.functions import parse as ps

PIECES = [
    '{"a": 1}', '{"a": {"b": 2}}', "{", "}", "```", "```json\n", "text ", "<think>", "</think>", "[1, 2]", "null", '"s"',
    "NaN", '{"a": NaN}', '{"a": 1, "a": 2}', "\n", " ", " ", "-3", "true", "tale", '{"x": "}"}', '{"a": 01}', "{'a': 1}", '{"é": "ü"}',
]


def by_the_rules(text):
    """The cascade written out directly; (found, value)."""
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S).strip()
    options = [text]
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    widest = re.search(r"\{.*\}", text, re.S)
    options += [fenced.group(1)] if fenced else []
    options += [widest.group(0)] if widest else []
    options += re.findall(r"\{[^{}]*\}", text)[::-1]
    for option in options:
        try:
            return json.loads(option)
        except json.JSONDecodeError:
            continue
    return None


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), min_size=60, max_size=60))
def test_parse_response_follows_the_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", ps.parse_response(F.col("t")).alias("j")).collect()}
    for i, text in enumerate(texts):
        want = by_the_rules(text)
        have = None if got[i] is None else json.loads(got[i])
        # JSON has no NaN: it is kept as null inside a value.
        assert have == json.loads(json.dumps(want).replace("NaN", "null")), (text, got[i])


def test_rewriting(spark):
    rows = [([("system", "s"), ("user", "at [1, 2,3, 4] and [9, 9, 9, 9]"), ("assistant", "x"), ("assistant", "<think>a</think>\ny")],)]
    df = spark.createDataFrame(rows, f"m {ms.MESSAGES}")
    r = df.select(
        ms.inject_empty_think(F.col("m")).alias("think"),
        ms.strip_ground_truth(F.col("m")).alias("open"),
        ms.strip_ground_truth(F.slice("m", 1, 2)).alias("kept"),
        ms.answer_text(F.col("m"), "last").alias("last"),
        ms.answer_text(F.col("m"), "first").alias("first"),
        ms.answer_text(F.slice("m", 4, 1), "first").alias("after"),
        ms.extract_box(F.col("m")).alias("box"),
    ).first()
    assert r.think[2].content == "<think>\n\n</think>\n\nx" and r.think[3].content == "<think>a</think>\ny"
    assert len(r.open) == 3 and len(r.kept) == 2
    assert (r["last"], r["first"], r["after"]) == ("<think>a</think>\ny", "x", "y")
    assert r.box == [1.0, 2.0, 3.0, 4.0]


def test_json_text_matches_the_standard_writer(spark):
    df = spark.createDataFrame([(["a", 'q"t'], [1, 2], 0.12345, True)], "s array<string>, n array<int>, x double, b boolean")
    text = df.select(
        ms.json_object(
            s=ms.quoted_list(F.col("s")), n=ms.number_list(F.col("n")), x=ms.number3(F.col("x")), b=ms.truth(F.col("b"))
        ).alias("t")
    ).first().t
    assert text == json.dumps({"s": ["a", 'q"t'], "n": [1, 2], "x": 0.123, "b": True})
