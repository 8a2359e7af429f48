"""Reading free-form model responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.binding import strip

# What counts as reasoning, a fenced object, a braced span and a flat object.
THINK = r"(?s)<think>.*?</think>"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACED = r"(?s)\{.*\}"
FLAT = r"\{[^{}]*\}"


def lenient_decoder():
    """A function from text to the JSON text of the value it holds, or None.

    Tried in turn: the whole text, a fenced object, the widest braced span, the
    last flat object. The function is self-contained, so Spark can ship it to
    executors that do not have this package.
    """
    fenced, braced, flat = re.compile(FENCED), re.compile(BRACED), re.compile(FLAT)

    def candidates(text):
        yield text
        for pattern, group in ((fenced, 1), (braced, 0)):
            match = pattern.search(text)
            if match:
                yield match.group(group)
        yield from reversed(flat.findall(text))

    def finite(value):
        if isinstance(value, float):
            return value if abs(value) < float("inf") else None
        if isinstance(value, list):
            return [finite(v) for v in value]
        return {k: finite(v) for k, v in value.items()} if isinstance(value, dict) else value

    def decode(text):
        for candidate in candidates(text or ""):
            try:
                value = json.loads(candidate)
            except (ValueError, RecursionError):
                continue
            return None if value is None else json.dumps(finite(value), separators=(",", ":"))
        return None

    return decode


def _lenient(column: Column) -> Column:
    decode = lenient_decoder()

    def over_batch(texts: pd.Series) -> pd.Series:
        # Texts that the JVM has decided are NULL here.
        return texts.map(decode, na_action="ignore")

    return F.pandas_udf(over_batch, T.StringType())(column)


# How a JSON text other than an object may begin.
OPENERS = list('"[-0123456789tfnNI')


def strip_think(text: Column) -> Column:
    """Remove closed reasoning blocks and surrounding white space."""
    return strip(F.regexp_replace(text, THINK, ""))


def parse_response(text: Column) -> Column:
    """JSON text of the value found in a response, or NULL.

    The usual answer, one flat object with or without text around it, is decoded
    in the JVM: every lenient rule would pick that object, unless the whole text
    is some other JSON value. A text without any brace that cannot be JSON has
    no answer. Only the other texts travel to Python, whose decoder defines the
    rules.
    """
    body = strip_think(F.coalesce(text, F.lit("")))
    other_json = F.substring(body, 1, 1).isin(*OPENERS)
    one_object = F.regexp_like(body, F.lit(r"^[^{}]*\{[^{}]*\}[^{}]*$")) & ~other_json
    flat = F.when(one_object, F.to_json(F.try_parse_json(F.regexp_extract(body, FLAT, 0))))
    hopeless = ~F.contains(body, F.lit("{")) & ~other_json
    return F.coalesce(flat, _lenient(F.when(flat.isNull() & ~hopeless, body)))


def is_object(json_text: Column) -> Column:
    return F.coalesce(json_text.startswith("{"), F.lit(False))


def parse_free_text(text: Column, classes: list[str], key: str) -> Column:
    """JSON object naming the last quoted class word, else the last bare one."""
    words = "|".join(classes)
    quoted = F.regexp_extract_all(text, F.lit(rf"(?i)[\"']({words})[\"']"), 1)
    bare = F.regexp_extract_all(text, F.lit(rf"(?i)\b({words})\b"), 1)
    word = F.lower(F.coalesce(F.try_element_at(quoted, F.lit(-1)), F.try_element_at(bare, F.lit(-1))))
    return F.when(word.isNotNull(), F.to_json(F.struct(word.alias(key))))


def field(document: Column, key: str) -> Column:
    """One member of a parsed answer, as VARIANT; JSON null and absence are both NULL."""
    value = F.try_variant_get(document, f"$['{key}']", "variant")
    return F.when(~F.is_variant_null(value), value)


def has_key(document: Column, key: str) -> Column:
    """True when the member exists, also with a null value."""
    return F.try_variant_get(document, f"$['{key}']", "variant").isNotNull()


def alias_get(document: Column, *keys: str) -> Column:
    """First member with content: empty text, empty lists, zero and false fall through to the last key."""
    return F.coalesce(*[_truthy(field(document, k)) for k in keys[:-1]], field(document, keys[-1]))


def _truthy(value: Column) -> Column:
    text = F.to_json(value)
    return F.when(~text.isin('""', "[]", "{}", "0", "0.0", "false"), value)


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def as_list(value: Column, element: str = "string") -> Column:
    """A list of one type; NULL when the value is not such a list."""
    return F.try_variant_get(value, "$", f"array<{element}>")


def coerce_number(value: Column) -> Column:
    """A number, or the first number of a list, or NULL."""
    first = F.try_variant_get(value, "$[0]", "double")
    return F.coalesce(F.try_variant_get(value, "$", "double"), F.when(is_list(value), first))


def coerce_int(value: Column) -> Column:
    """A number cut to its whole part, true as 1, digits in text; else NULL."""
    number = F.try_variant_get(value, "$", "double")
    digits = strip(as_text(value)).try_cast("long")
    return F.when(is_text(value), digits).otherwise(
        F.coalesce(number.cast("long"), F.try_variant_get(value, "$", "boolean").cast("long"))
    )


# Spellings of yes and no.
YES = ["1", "true", "yes", "funny"]
NO = ["0", "false", "no", "not funny"]


def coerce_binary(value: Column) -> Column:
    """Booleans and numbers as integers, known words as 1 or 0, else NULL."""
    word = F.lower(strip(as_text(value)))
    spoken = F.when(word.isin(*YES), 1).when(word.isin(*NO), 0)
    return F.when(is_text(value), spoken).otherwise(coerce_int(value).cast("int"))


def coerce_label(value: Column, missing: str | None = None) -> Column:
    """Title-cased text of a label, or of the first label of a list."""
    first = F.when(is_list(value), F.try_variant_get(value, "$[0]", "string")).otherwise(as_text(value))
    label = F.initcap(strip(first))
    return label if missing is None else F.coalesce(F.nullif(label, F.lit("")), F.lit(missing))


def flatten_labels(value: Column) -> Column:
    """One-level flattening: NULL gives [], anything but a list gives NULL."""
    items = F.try_variant_get(value, "$", "array<variant>")
    flat = F.flatten(
        F.transform(
            items,
            lambda v: F.when(is_list(v), as_list(v))
            .when(is_text(v), F.array(as_text(v)))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    return F.when(value.isNull(), F.array().cast("array<string>")).when(is_list(value), flat)
