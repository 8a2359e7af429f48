"""Numbers. ``pairs`` holds ``gt_<dim>`` and ``pred_<dim>`` columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.metrics.common import to_long


def _ccc(x: Column, y: Column) -> Column:
    spread = F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) * (F.avg(x) - F.avg(y))
    return F.when(spread < 1e-10, F.lit(0.0)).otherwise(2 * F.covar_pop(x, y) / spread)


def ccc(pairs: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """Concordance correlation per dimension and its mean; inputs have float precision."""
    number = lambda c: F.col(c).cast("float").cast("double")
    wide = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), *[_ccc(number(f"pred_{d}"), number(f"gt_{d}")).alias(f"ccc_{d}") for d in dims]
    )
    values = {f"ccc_{d}": F.col(f"ccc_{d}") for d in dims}
    values["ccc_mean"] = reduce(lambda a, b: a + b, values.values()) / len(dims)
    return to_long(wide, by, values, F.col("n"))


def aae(pairs: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """Average absolute error per dimension; the overall mean pools all given errors.

    A dimension whose prediction is NULL adds nothing; ``n_used`` counts the
    rows that have the first dimension.
    """
    error = {d: F.abs(F.col(f"pred_{d}").cast("double") - F.col(f"gt_{d}").cast("double")) for d in dims}
    wide = pairs.groupBy(*by).agg(
        *[F.avg(e).alias(f"aae_{d}") for d, e in error.items()],
        *[F.sum(e).alias(f"s_{d}") for d, e in error.items()],
        *[F.count(e).alias(f"n_{d}") for d, e in error.items()],
    )
    pooled = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s_{d}"), F.lit(0.0)) for d in dims]) / reduce(
        lambda a, b: a + b, [F.col(f"n_{d}") for d in dims]
    )
    values = {f"aae_{d}": F.col(f"aae_{d}") for d in dims}
    values["aae_mean"] = F.when(F.col(f"n_{dims[0]}") > 0, pooled)
    return to_long(wide, by, values, F.col(f"n_{dims[0]}"))


def count_mae(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error and exact hits of whole numbers ``gt`` and ``pred``."""
    wide = pairs.groupBy(*by).agg(
        F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("mae"),
        F.avg((F.col("gt") == F.col("pred")).cast("double")).alias("exact"),
        F.count("*").alias("n"),
    )
    return to_long(wide, by, {"mae": F.col("mae"), "exact_accuracy": F.col("exact")}, F.col("n"))
