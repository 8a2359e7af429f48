"""Expectations on built tables: one pass, one boolean column per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.binding import strip
from tallyframe.functions.parse import field

ROLES = ["system", "user", "assistant"]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def roles_are(messages: str, roles: list[str] = ROLES) -> Column:
    return F.transform(messages, lambda m: m["role"]) == F.array(*[F.lit(r) for r in roles])


def user_mentions(messages: str, *needles: str) -> Column:
    """Every needle occurs in the second turn."""
    content = F.get(F.col(messages), F.lit(1))["content"]
    ok = F.lit(True)
    for needle in needles:
        ok = ok & F.contains(content, F.lit(needle))
    return ok


def answer_of(messages: str) -> Column:
    """Third turn without its reasoning block, as VARIANT; NULL when it is not JSON."""
    content = F.get(F.col(messages), F.lit(2))["content"]
    return F.try_parse_json(strip(F.element_at(F.split(content, "</think>"), -1)))


def answer_has(answer: Column, key: str, kind: str | None = None) -> Column:
    """The key exists and, if asked, has a type such as ``BOOLEAN``, ``BIGINT`` or ``ARRAY``."""
    value = field(answer, key)
    return value.isNotNull() if kind is None else F.schema_of_variant(value).startswith(kind)


def number_between(value: Column, low: float, high: float) -> Column:
    return F.try_variant_get(value, "$", "double").between(low, high)


def all_numbers_between(value: Column, low: float, high: float, length: int) -> Column:
    numbers = F.try_variant_get(value, "$", "array<double>")
    return (F.size(numbers) == length) & F.forall(numbers, lambda x: x.between(low, high))


def texts_of_length(value: Column, length: int) -> Column:
    return F.size(F.try_variant_get(value, "$", "array<string>")) == length


def label_in(value: Column, names: list[str]) -> Column:
    return F.try_variant_get(value, "$", "string").isin(*names)


def labels_in(value: Column, names: list[str]) -> Column:
    listed = F.try_variant_get(value, "$", "array<string>")
    return F.forall(listed, lambda x: x.isin(*names))


def think_block(messages: str) -> Column:
    content = F.get(F.col(messages), F.lit(2))["content"]
    return F.contains(content, F.lit("<think>")) & F.contains(content, F.lit("</think>"))


def media_is(column: str, count: int = 1, min_bytes: int = 0, member: str | None = None) -> Column:
    """``count`` media items, each larger than ``min_bytes``."""
    content = (lambda m: m[member]) if member else (lambda m: m)
    return (F.size(column) == count) & F.forall(column, lambda m: F.octet_length(content(m)) > min_bytes)


def expect(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """Rows checked, rows failed and the first failing id per rule; NULL counts as failed."""
    aggregates = [F.count("*").cast("long").alias("n_rows")]
    for i, rule in enumerate(rules.values()):
        failed = ~F.coalesce(rule, F.lit(False))
        aggregates += [
            F.count_if(failed).alias(f"bad{i}"),
            F.min(F.when(failed, F.col(row_id))).alias(f"first{i}"),
        ]
    cells = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col("n_rows").alias("n_rows"),
            F.col(f"bad{i}").cast("long").alias("n_failed"),
            F.col(f"first{i}").alias("first_failing_id"),
        )
        for i, name in enumerate(rules)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def label_distribution(df: DataFrame, label: Column, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))


def number_stats(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Minimum, maximum and mean per column."""
    wide = df.groupBy(*by).agg(
        *[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max, F.avg)]
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"min_{c}").alias("min"),
            F.col(f"max_{c}").alias("max"),
            F.col(f"avg_{c}").alias("mean"),
        )
        for c in columns
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


def build_status(expected: DataFrame, inputs: DataFrame, built: DataFrame) -> DataFrame:
    """ok, skipped (an input is missing) or failed (no output or a failed check) per dataset.

    ``expected`` lists ``dataset, path``; ``inputs`` the existing ``path`` values;
    ``built`` holds ``dataset, n_rows, n_failed``.
    """
    missing = (
        expected.join(inputs.select("path").distinct().withColumn("__here", F.lit(1)), "path", "left")
        .groupBy("dataset")
        .agg(F.count_if(F.col("__here").isNull()).alias("n_missing"))
    )
    status = (
        F.when(F.col("n_missing") > 0, "skipped")
        .when(F.coalesce(F.col("n_rows"), F.lit(0)) == 0, "failed")
        .when(F.col("n_failed") > 0, "failed")
        .otherwise("ok")
    )
    return missing.join(built, "dataset", "left").select("dataset", status.alias("status"), "n_missing", "n_rows")
