"""Labels, label sets and answers given by several annotators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.binding import strip


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def decode_label(code: Column, mapping: dict) -> Column:
    """Look a code up in a fixed table; unknown codes become NULL."""
    return F.try_element_at(_map_literal(mapping), code)


def decode_index(index: Column, names: list[str]) -> Column:
    """Name at a 0-based position; NULL outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def fold_prefix(label: Column, prefix: str, target: str) -> Column:
    """Map every label starting with ``prefix`` (any case) to ``target``."""
    return F.when(F.lower(label).startswith(prefix.lower()), F.lit(target)).otherwise(label)


def onehot_to_labels(vector: Column, names: list[str]) -> Column:
    """Names of the positions equal to 1."""
    pairs = F.arrays_zip(vector.alias("flag"), F.array(*[F.lit(n) for n in names]).alias("name"))
    hits = F.filter(pairs, lambda p: p["flag"] == 1)
    return F.transform(hits, lambda p: p["name"])


def to_indicator(labels: Column, classes: list[str]) -> Column:
    """0/1 vector in class order."""
    known = F.coalesce(labels, F.array().cast("array<string>"))
    return F.array(*[F.array_contains(known, c).cast("int") for c in classes])


def parse_units(text: Column) -> Column:
    """``'6+12'`` to ``['AU6', 'AU12']``; unreadable parts are dropped, NULL gives []."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"\+")
    numbers = F.transform(parts, lambda p: strip(p).try_cast("double").cast("long"))
    return F.transform(
        F.filter(numbers, lambda n: n.isNotNull()), lambda n: F.concat(F.lit("AU"), n.cast("string"))
    )


def units_phrase(text: Column) -> Column:
    """``'6+12'`` to ``'AU6+12'``; NULL or blank gives ``'none'``."""
    trimmed = strip(text.cast("string"))
    return F.when(trimmed.isNull() | (trimmed == ""), "none").otherwise(F.concat(F.lit("AU"), trimmed))


def person_phrase(gender: Column, age: Column) -> Column:
    """'female adult', 'male person', 'teenager' or 'person'."""
    known = lambda c: F.when(F.coalesce(c, F.lit("Unknown")) != "Unknown", F.lower(c))
    g, a = known(gender), known(age)
    return F.coalesce(F.concat(g, F.lit(" "), a), F.concat(g, F.lit(" person")), a, F.lit("person"))


def annotator_union(per_annotator: Column) -> Column:
    """Distinct labels over all annotators."""
    return F.array_distinct(F.flatten(per_annotator))


def annotator_mean(values: Column, empty: float | None = None) -> Column:
    """Mean over annotators, NULLs left out; ``empty`` when nobody answered."""
    given = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mean = F.when(F.size(given) > 0, total / F.size(given))
    return mean if empty is None else F.coalesce(mean, F.lit(float(empty)))


def annotator_vote(labels: Column, order: list[str] | None = None, empty: str | None = None) -> Column:
    """Most frequent label. Ties follow ``order``, or first appearance when it is None."""
    names = F.array_distinct(labels)
    if order is None:
        rank = lambda name: F.array_position(labels, name)
    else:
        ordered = F.array(*[F.lit(o) for o in order])
        rank = lambda name: F.coalesce(
            F.nullif(F.array_position(ordered, name), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long")
        )
    scored = F.transform(
        names,
        lambda name: F.struct(
            F.size(F.filter(labels, lambda x: x == name)).alias("n"),
            (-rank(name)).alias("r"),
            F.array_position(names, name).__neg__().alias("p"),
            name.alias("name"),
        ),
    )
    winner = F.array_max(scored)["name"]
    return winner if empty is None else F.coalesce(winner, F.lit(empty))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct labels; two empty sets agree fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def index_to_time(index: Column, fps: int = 30) -> Column:
    """Seconds of a frame, as text with two decimals."""
    return F.format_string("%.2f", index.cast("double") / fps)
