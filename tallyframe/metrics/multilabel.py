"""Label sets. ``pairs`` holds ``gt`` and ``pred`` as arrays of text.

All classes are counted in one hash aggregation over the rows, without
exploding them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import jaccard, to_indicator
from tallyframe.metrics.common import NAN, key_of, ratio, to_long


def indicator_counts(pairs: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """Per class: rows with it in both sets, in gt, in pred, and rows where gt and pred agree."""
    counts = [F.count("*").alias("n")]
    for i, name in enumerate(classes):
        g, p = F.array_contains("gt", name), F.array_contains("pred", name)
        counts += [
            F.count_if(g & p).alias(f"tp{i}"),
            F.count_if(g).alias(f"gt{i}"),
            F.count_if(p).alias(f"pr{i}"),
        ]
    return pairs.groupBy(*by).agg(*counts)


def multilabel_report(
    pairs: DataFrame,
    by: list[str],
    classes: list[str],
    per_class: list[str] = ("f1",),
    macro: dict[str, str] | None = None,
    lower: bool = True,
) -> DataFrame:
    """Per-class scores and their mean over the classes present in the ground truth.

    ``macro`` maps a per-class score (``f1``, ``ap``) to the name of its mean;
    the mean is NaN when no class is present. ``acc`` needs no presence.
    """
    n = F.col("n")
    scores: dict[str, list[Column]] = {"f1": [], "ap": [], "acc": []}
    for i in range(len(classes)):
        tp, gt, pr = F.col(f"tp{i}"), F.col(f"gt{i}"), F.col(f"pr{i}")
        precision, recall, share = ratio(tp, pr), ratio(tp, gt), gt / n
        scores["f1"].append(F.when(gt > 0, ratio(2 * tp, gt + pr)))
        scores["ap"].append(F.when(gt > 0, precision * recall + (1 - recall) * share))
        scores["acc"].append((n - gt - pr + 2 * tp) / n)
    values: dict[str, Column] = {}
    for kind in per_class:
        for name, score in zip(classes, scores[kind]):
            values[f"{kind}_{key_of(name) if lower else name}"] = score
    for kind, out in (macro or {}).items():
        listed = F.filter(F.array(*scores[kind]), lambda x: x.isNotNull())
        summed = F.aggregate(listed, F.lit(0.0), lambda acc, x: acc + x)
        values[out] = F.when(F.size(listed) > 0, summed / F.size(listed)).otherwise(F.lit(NAN))
    return to_long(indicator_counts(pairs, by, classes), by, values, n)


def exact_match(pairs: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """Share of rows whose indicator vectors are equal."""
    same = to_indicator(F.col("gt"), classes) == to_indicator(F.col("pred"), classes)
    wide = pairs.groupBy(*by).agg(F.avg(same.cast("double")).alias("v"), F.count("*").alias("n"))
    return to_long(wide, by, {"exact_match_accuracy": F.col("v")}, F.col("n"))


def mean_jaccard(pairs: DataFrame, by: list[str]) -> DataFrame:
    wide = pairs.groupBy(*by).agg(F.avg(jaccard(F.col("gt"), F.col("pred"))).alias("v"), F.count("*").alias("n"))
    return to_long(wide, by, {"mean_jaccard": F.col("v")}, F.col("n"))
