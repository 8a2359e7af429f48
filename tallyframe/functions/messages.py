"""Chat rows: building, rewriting and reading the ``messages`` array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.binding import strip

MESSAGES = "array<struct<role:string,content:string>>"

# The reasoning block a trainer expects in front of an answer.
EMPTY_THINK = "<think>\n\n</think>\n\n"
# A box written in a prompt.
BOX_PATTERN = r"\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]"


def _turn(role: str, content: Column | str) -> Column:
    content = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(system: Column | str, user: Column | str, answer: Column) -> Column:
    """The three turns of a built sample."""
    return F.array(_turn("system", system), _turn("user", user), _turn("assistant", answer)).cast(MESSAGES)


def read_messages(column: Column, is_text: bool) -> Column:
    """Messages stored as JSON text or as an array."""
    return F.from_json(column, MESSAGES) if is_text else column


def quoted(text: Column) -> Column:
    """JSON text of a string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def number_list(values: Column) -> Column:
    """``[1, 2, 3]``"""
    texts = F.transform(values, lambda v: v.cast("string"))
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def quoted_list(values: Column) -> Column:
    """``["a", "b"]``"""
    texts = F.transform(values, quoted)
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def nested_list(values: Column, inner) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, inner), ", "), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """JSON object text from already encoded values, with a space after ``:`` and ``,``."""
    parts: list[Column] = [F.lit("{")]
    for i, (name, text) in enumerate(fields.items()):
        parts += [F.lit(f'{", " if i else ""}"{name}": '), text]
    return F.concat(*parts, F.lit("}"))


def number3(value: Column) -> Column:
    """A float rounded to three decimals, as JSON text."""
    return F.bround(value.cast("double"), 3).cast("string")


def truth(value: Column) -> Column:
    return value.cast("boolean").cast("string")


def box_text(box: Column) -> Column:
    """``[x1, y1, x2, y2]`` as written in prompts."""
    return number_list(box)


def numbered_people(boxes: Column) -> Column:
    """One ``Person i: [box]`` line per face."""
    lines = F.transform(
        boxes, lambda b, i: F.concat(F.lit("Person "), (i + 1).cast("string"), F.lit(": "), number_list(b))
    )
    return F.array_join(lines, "\n")


def keypoint_lines(title: str, points: Column, names: list[str], point) -> Column:
    """A title, then ``  - name: [x, y]`` for every named point."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), points.alias("at"))
    lines = F.transform(
        F.slice(pairs, 1, F.least(F.size(points), F.lit(len(names)))),
        lambda p: F.concat(F.lit("  - "), p["name"], F.lit(": "), number_list(point(p["at"]))),
    )
    return F.array_join(F.concat(F.array(F.lit(title)), lines), "\n")


def dialogue_lines(texts: Column, speakers: Column | None = None) -> Column:
    """``  - speaker: "text"`` lines, or ``  - "text"`` without speakers."""
    if speakers is None:
        lines = F.transform(texts, lambda t: F.concat(F.lit('  - "'), t, F.lit('"')))
    else:
        pairs = F.slice(
            F.arrays_zip(speakers.alias("who"), texts.alias("said")),
            F.lit(1),
            F.least(F.size(speakers), F.size(texts)),
        )
        lines = F.transform(
            pairs, lambda p: F.concat(F.lit("  - "), p["who"], F.lit(': "'), p["said"], F.lit('"'))
        )
    return F.array_join(lines, "\n")


def reasoning_block(content: Column, answer: Column) -> Column:
    """``<think>`` content, then the answer."""
    return F.concat(F.lit("<think>\n"), content, F.lit("\n</think>\n"), answer)


def inject_empty_think(messages: Column) -> Column:
    """Prefix assistant turns that have no reasoning block with an empty one."""
    return F.transform(
        messages,
        lambda m: F.when(
            (m["role"] == "assistant") & ~m["content"].startswith("<think>"),
            F.struct(m["role"].alias("role"), F.concat(F.lit(EMPTY_THINK), m["content"]).alias("content")),
        ).otherwise(m),
    )


def strip_ground_truth(messages: Column) -> Column:
    """Drop the last turn when the assistant speaks it."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(
        messages
    )


def turns_of(messages: Column, role: str) -> Column:
    """Contents of the turns of one role, in order."""
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def answer_text(messages: Column, which: str = "last") -> Column:
    """The assistant turn that holds the ground truth.

    ``last`` is what scoring reads; ``first`` is what the baselines read, with
    everything up to the last ``</think>`` removed.
    """
    turns = turns_of(messages, "assistant")
    if which == "last":
        return F.try_element_at(turns, F.lit(-1))
    text = F.try_element_at(turns, F.lit(1))
    after = strip(F.substring_index(text, "</think>", -1))
    return F.when(F.contains(text, F.lit("<think>")), after).otherwise(text)


def extract_box(messages: Column) -> Column:
    """The first box written in a user turn, as doubles."""
    contents = F.filter(turns_of(messages, "user"), lambda c: F.regexp_like(c, F.lit(BOX_PATTERN)))
    content = F.try_element_at(contents, F.lit(1))
    return F.when(
        content.isNotNull(),
        F.array(*[F.regexp_extract(content, BOX_PATTERN, i).cast("double") for i in range(1, 5)]),
    )


def answer_by_split(split: Column, single: Column, all_annotators: Column, train: str = "train") -> Column:
    """Training rows carry one answer, the other splits the answers of all annotators."""
    return F.when(split == train, single).otherwise(all_annotators)
