"""Points and boxes on the 0..1000 grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.geometry import (
    GRID,
    angle_between,
    box_center,
    direction,
    distance,
    iou,
    point_of,
)
from tallyframe.metrics.common import NAN, to_long


def _unit(point: Column) -> Column:
    return F.array(point[0] / GRID, point[1] / GRID)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def _row_means(pairs: DataFrame, by: list[str], values: Column, low: str, mean: str) -> DataFrame:
    rows = pairs.withColumn("__v", values)
    wide = rows.groupBy(*by).agg(
        F.avg(F.array_min("__v")).alias("low"), F.avg(_mean(F.col("__v"))).alias("mean"), F.count("*").alias("n")
    )
    return to_long(wide, by, {low: F.col("low"), mean: F.col("mean")}, F.col("n"))


def gaze_distance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Smallest and mean distance from ``pred`` to the annotated points ``gt``."""
    at = _unit(point_of(F.col("pred")))
    return _row_means(
        pairs, by, F.transform("gt", lambda g: distance(at, _unit(g))), "min_dist", "avg_dist"
    )


def gaze_angle(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Angle seen from the centre of ``head`` between ``pred`` and each annotated point."""
    rows = pairs.where(F.col("head").isNotNull())
    rows = rows.withColumn("__eye", _unit(box_center(F.col("head"))))
    rows = rows.withColumn("__look", direction(F.col("__eye"), _unit(point_of(F.col("pred")))))
    angles = F.transform("gt", lambda g: angle_between(F.col("__look"), direction(F.col("__eye"), _unit(g))))
    return _row_means(rows, by, angles, "min_angular_error", "avg_angular_error")


def in_frame_distance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distance of points ``gt`` and ``pred``; three-number predictions are left out."""
    rows = pairs.where(F.size("pred").isin(2, 4) & (F.size("gt") >= 2))
    far = distance(_unit(point_of(F.col("pred"))), _unit(F.col("gt")))
    wide = rows.groupBy(*by).agg(F.avg(far).alias("v"), F.count("*").alias("n"))
    return to_long(wide, by, {"dist": F.col("v")}, F.col("n"))


def box_overlap(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean IoU and mean centre distance of boxes."""
    far = distance(box_center(F.col("pred")), box_center(F.col("gt"))) / GRID
    wide = pairs.groupBy(*by).agg(
        F.avg(iou(F.col("pred"), F.col("gt"))).alias("iou"), F.avg(far).alias("l2"), F.count("*").alias("n")
    )
    return to_long(wide, by, {"mean_iou": F.col("iou"), "l2_dist": F.col("l2")}, F.col("n"))


# Side of the pixel grid, width of a point, level of a positive pixel.
HEAT_SIZE = 64
HEAT_SIGMA = 3.0
HEAT_LEVEL = 0.5


def heatmap_auc_column(pred: Column, points: Column) -> Column:
    """AUC of one row: pixels near the annotated points against the heat of the predicted point.

    A missing prediction has no heat anywhere. Pixels have float precision, so
    far pixels tie at zero. The 4,096 pixels of a row never leave its task.
    """
    size, sigma, level, grid = HEAT_SIZE, HEAT_SIGMA, HEAT_LEVEL, GRID

    def over_batch(preds: pd.Series, gts: pd.Series) -> pd.Series:
        axis = np.arange(size, dtype=np.float32)

        def heat(point):
            if point is None or len(point) < 2:
                return np.zeros(size * size, dtype=np.float32)
            x, y = (np.float32(v / grid * (size - 1)) for v in point[:2])
            squared = (axis[None, :] - x) ** 2 + (axis[:, None] - y) ** 2
            return np.exp(-squared / np.float32(2 * sigma**2)).ravel()

        def score(pred, gt):
            target = np.zeros(size * size, dtype=np.float32)
            for point in gt:
                target += heat(point)
            peak = target.max()
            positive = (target / peak if peak > 0 else target) >= level
            n_pos = int(positive.sum())
            n_neg = positive.size - n_pos
            if n_pos == 0 or n_neg == 0:
                return None
            scores = heat(pred)
            rivals, hits = np.sort(scores[~positive]), scores[positive]
            below = np.searchsorted(rivals, hits, "left")
            wins = (below + np.searchsorted(rivals, hits, "right")).sum() / 2
            return float(wins / (n_pos * n_neg))

        return pd.Series([score(p, g) for p, g in zip(preds, gts)], dtype="float64")

    return F.pandas_udf(over_batch, T.DoubleType())(pred, points)


def heatmap_auc(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean heatmap AUC of ``pred`` against the points ``gt``; rows without both classes are skipped.

    A row costs far more to score than to move, so the narrow rows are first
    spread evenly over all tasks.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select(*by, "pred", "gt").repartition(tasks)
    rows = rows.withColumn("__auc", heatmap_auc_column(F.col("pred"), F.col("gt")))
    value = F.when(~F.isnan("__auc"), F.col("__auc"))
    wide = rows.groupBy(*by).agg(
        F.coalesce(F.avg(value), F.lit(NAN)).alias("v"), F.count("*").alias("n")
    )
    return to_long(wide, by, {"auc": F.col("v")}, F.col("n"))
