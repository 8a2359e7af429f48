"""Single-label classification. ``pairs`` holds ``gt`` and ``pred``.

Rows are counted once per (group, gt, pred) with a map-side combine; everything
after that works on the confusion counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.metrics.common import key_of, ratio, to_long


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by, "gt", "pred").agg(F.count("*").alias("n"))


def class_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """True positives, support and predictions of every label seen on either side."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gt").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        confusion(pairs, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
        .withColumns(
            {
                "precision": ratio(F.col("tp"), F.col("predicted")),
                "recall": ratio(F.col("tp"), F.col("support")),
                "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
            }
        )
    )


def classification_report(
    pairs: DataFrame,
    by: list[str],
    outputs: list[str],
    classes: list[str] | None = None,
    per_class: list[str] = (),
    skip_absent: bool = False,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Accuracy and averages of per-class scores.

    outputs
        Any of ``accuracy``, ``macro_f1``, ``weighted_f1``, ``uar``, ``mAP``,
        ``precision``, ``recall`` (of the label ``1``), ``ua``, ``wa``.
    classes
        Fixed list: absent classes count as 0. None: every label seen in the
        ground truth or the predictions.
    per_class
        Any of ``f1``, ``ap``, ``recall``, ``precision`` for the fixed list.
    skip_absent
        Leave classes without ground truth out of ``mAP`` and of the per-class rows.
    names
        Metric suffix per class, by default the class name in lower case.
    """
    label, support = F.col("label"), F.col("support")
    scope = label.isin(*classes) if classes else F.lit(True)
    total = F.sum("support")
    spread = (1 - F.col("recall")) * support
    hit = F.col("precision") * F.col("recall")

    def average(score: Column) -> Column:
        summed = F.coalesce(F.sum(F.when(scope, score)), F.lit(0.0))
        return summed / len(classes) if classes else summed / F.count("*")

    def of(name: str, score: Column) -> Column:
        return F.max(F.when(label == name, score))

    present = F.sum(F.when(scope & (support > 0), 1))
    summary: dict[str, Column] = {
        "accuracy": F.sum("tp") / total,
        "wa": F.sum("tp") / total,
        "macro_f1": average(F.col("f1")),
        "uar": average(F.col("recall")),
        "ua": F.avg(F.when(support > 0, F.col("recall"))),
        "weighted_f1": ratio(
            F.sum(F.when(scope, F.col("f1") * support)), F.coalesce(F.sum(F.when(scope, support)), F.lit(0))
        ),
        "precision": F.coalesce(of("1", F.col("precision")), F.lit(0.0)),
        "recall": F.coalesce(of("1", F.col("recall")), F.lit(0.0)),
        "f1": F.coalesce(of("1", F.col("f1")), F.lit(0.0)),
        "mAP": F.coalesce(
            (F.sum(F.when(scope & (support > 0), hit)) + F.sum(F.when(scope & (support > 0), spread)) / total)
            / present,
            F.lit(float("nan")),
        ),
    }
    wide = {m: summary[m] for m in outputs}
    for name in classes or []:
        suffix = (names or {}).get(name, key_of(name))
        scores = {
            "ap": of(name, hit) + of(name, spread) / total,
            "recall": of(name, F.col("recall")),
            "precision": of(name, F.col("precision")),
            "f1": of(name, F.col("f1")),
        }
        for kind in per_class:
            score = F.coalesce(scores[kind], F.lit(0.0))
            if skip_absent:
                score = F.when(of(name, support) > 0, score)
            wide[f"{kind}_{suffix}"] = score
    counted = class_counts(pairs, by).groupBy(*by).agg(
        total.alias("n_used"), *[v.alias(f"m{i}") for i, v in enumerate(wide.values())]
    )
    return to_long(counted, by, {m: F.col(f"m{i}") for i, m in enumerate(wide)}, F.col("n_used"))
