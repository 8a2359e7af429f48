"""Coordinates, gaze points, boxes and heatmaps over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import geometry as geo
from tallyframe.metrics import localization as loc
from tallyframe.queries.base import Tables, query, r6, scores, unpivot


def _spread(factor: int, column: str = "event_id") -> F.Column:
    return (F.col(column) * factor % 1001).cast("double")


def _points(t: Tables):
    """Per event: three annotated points, a predicted point or box, a head box."""
    box = F.array(*[_spread(f) for f in (13, 17, 29, 31)])
    pred = (
        F.when(F.col("value") < 2, F.lit(None).cast("array<double>"))
        .when(F.col("value") < 10, box)
        .otherwise(F.array(_spread(37), _spread(91)))
    )
    return t.events.select(
        "event_id",
        F.col("event_type").alias("grp"),
        "value",
        F.array(*[F.array(_spread(a), _spread(b)) for a, b in ((41, 97), (43, 89), (53, 61))]).alias("gt"),
        pred.alias("pred"),
        F.when(F.col("value") > 3, F.array(_spread(7), _spread(11), _spread(19), _spread(23))).alias("head"),
    )


def _s(factor: int) -> str:
    return f"CAST(event_id * {factor} % 1001 AS DOUBLE)"


PRED_X = f"CASE WHEN value < 10 THEN ({_s(13)} + {_s(29)}) / 2 ELSE {_s(37)} END"
PRED_Y = f"CASE WHEN value < 10 THEN ({_s(17)} + {_s(31)}) / 2 ELSE {_s(91)} END"
GT = [(41, 97), (43, 89), (53, 61)]


def _dist(i: int) -> str:
    return f"sqrt((px - gx{i}) * (px - gx{i}) + (py - gy{i}) * (py - gy{i}))"


GAZE = (
    f"p AS (SELECT event_type AS grp, value, ({PRED_X}) / 1000 AS px, ({PRED_Y}) / 1000 AS py, "
    + ", ".join(f"{_s(a)} / 1000 AS gx{i}, {_s(b)} / 1000 AS gy{i}" for i, (a, b) in enumerate(GT))
    + f", ({_s(7)} + {_s(19)}) / 2000 AS hx, ({_s(11)} + {_s(23)}) / 2000 AS hy FROM events WHERE value >= 2)"
)


@query(
    "gaze_distance",
    f"WITH {GAZE}, wide AS (SELECT grp, count(*) AS n, avg(least({_dist(0)}, {_dist(1)}, {_dist(2)})) AS lo, "
    f"avg(({_dist(0)} + {_dist(1)} + {_dist(2)}) / 3) AS mid FROM p GROUP BY grp) "
    + unpivot("wide", ["grp"], {"min_dist": "lo", "avg_dist": "mid"}),
)
def gaze_distance(spark, sf_dir):
    rows = _points(Tables(spark, sf_dir)).where("pred IS NOT NULL")
    return scores(loc.gaze_distance(rows, ["grp"]))


def _angle(i: int) -> str:
    lp, lg = "sqrt((px - hx) * (px - hx) + (py - hy) * (py - hy))", f"sqrt((gx{i} - hx) * (gx{i} - hx) + (gy{i} - hy) * (gy{i} - hy))"
    return (
        f"degrees(acos(CASE WHEN {lp} < 1e-8 OR {lg} < 1e-8 THEN 0 ELSE greatest(-1.0, least(1.0, "
        f"(px - hx) / {lp} * ((gx{i} - hx) / {lg}) + (py - hy) / {lp} * ((gy{i} - hy) / {lg}))) END))"
    )


@query(
    "gaze_angle",
    f"WITH {GAZE}, wide AS (SELECT grp, count(*) AS n, avg(least({_angle(0)}, {_angle(1)}, {_angle(2)})) AS lo, "
    f"avg(({_angle(0)} + {_angle(1)} + {_angle(2)}) / 3) AS mid FROM p WHERE value > 3 GROUP BY grp) "
    + unpivot("wide", ["grp"], {"min_angular_error": "lo", "avg_angular_error": "mid"}),
)
def gaze_angle(spark, sf_dir):
    rows = _points(Tables(spark, sf_dir)).where("pred IS NOT NULL")
    return scores(loc.gaze_angle(rows, ["grp"]))


@query(
    "gaze_in_frame",
    f"WITH {GAZE}, wide AS (SELECT grp, count(*) AS n, avg({_dist(0)}) AS v FROM p WHERE value < 40 OR value >= 60 GROUP BY grp) "
    + unpivot("wide", ["grp"], {"dist": "v"}),
)
def gaze_in_frame(spark, sf_dir):
    rows = _points(Tables(spark, sf_dir)).where("pred IS NOT NULL")
    three = F.array(F.col("pred")[0], F.col("pred")[1], F.lit(0.0))
    rows = rows.withColumns(
        {
            "gt": F.col("gt")[0],
            "pred": F.when((F.col("value") >= 40) & (F.col("value") < 60), three).otherwise(F.col("pred")),
        }
    )
    return scores(loc.in_frame_distance(rows, ["grp"]))


BOXES = (
    f"b AS (SELECT event_type AS grp, {_s(13)} AS p0, {_s(17)} AS p1, {_s(29)} AS p2, {_s(31)} AS p3, "
    f"least({_s(41)}, {_s(97)}) AS g0, least({_s(43)}, {_s(89)}) AS g1, greatest({_s(41)}, {_s(97)}) AS g2, greatest({_s(43)}, {_s(89)}) AS g3 FROM events), "
    "o AS (SELECT *, greatest(0, least(p2, g2) - greatest(p0, g0)) * greatest(0, least(p3, g3) - greatest(p1, g1)) AS inter, "
    "greatest(0, p2 - p0) * greatest(0, p3 - p1) + greatest(0, g2 - g0) * greatest(0, g3 - g1) AS areas FROM b)"
)


@query(
    "bbox_iou",
    f"WITH {BOXES}, wide AS (SELECT grp, count(*) AS n, avg(CASE WHEN areas - inter <= 0 THEN 0 ELSE inter / (areas - inter) END) AS iou, "
    "avg(sqrt(((p0 + p2 - g0 - g2) / 2) ** 2 + ((p1 + p3 - g1 - g3) / 2) ** 2) / 1000) AS l2 FROM o GROUP BY grp) "
    + unpivot("wide", ["grp"], {"mean_iou": "iou", "l2_dist": "l2"}),
)
def bbox_iou(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.select(
        F.col("event_type").alias("grp"),
        F.array(*[_spread(f) for f in (13, 17, 29, 31)]).alias("pred"),
        F.array(
            F.least(_spread(41), _spread(97)),
            F.least(_spread(43), _spread(89)),
            F.greatest(_spread(41), _spread(97)),
            F.greatest(_spread(43), _spread(89)),
        ).alias("gt"),
    )
    return scores(loc.box_overlap(rows, ["grp"]))


PIXEL = "CAST(event_id * 37 % 700 AS DOUBLE) - 20"


@query(
    "norm_bbox",
    f"SELECT event_id, greatest(0, least(1000, CAST(round_even(({PIXEL}) / 480 * 1000, 0) AS INTEGER))) AS clamped, "
    f"CAST(round_even(({PIXEL}) / 224 * 1000, 0) AS INTEGER) AS rounded, "
    f"greatest(0, least(1000, CAST(trunc(({PIXEL}) / 480 * 1000) AS INTEGER))) AS truncated, "
    "CAST(round_even(value / 1000 * 1000, 0) AS INTEGER) AS unit, "
    "CAST(round_even(CAST(event_id * 91 % 1001 AS DOUBLE) / 1000 * 480, 0) AS INTEGER) AS pixels FROM events",
)
def norm_bbox(spark, sf_dir):
    pixel = (F.col("event_id") * 37 % 700).cast("double") - 20
    return Tables(spark, sf_dir).events.select(
        "event_id",
        geo.norm1000(pixel, 480, "clamp").alias("clamped"),
        geo.norm1000(pixel, 224, "round").alias("rounded"),
        geo.norm1000(pixel, 480, "truncate").alias("truncated"),
        geo.norm1000(F.col("value") / 1000, 1, "unit").alias("unit"),
        geo.denorm(_spread(91), 480).alias("pixels"),
    )


@query(
    "bbox_convert",
    "SELECT event_id, concat_ws(',', x, y, x + w, y + h) AS from_xywh, concat_ws(',', w, x, h, y) AS from_yyxx FROM "
    "(SELECT event_id, event_id * 13 % 500 AS x, event_id * 17 % 500 AS y, event_id * 29 % 500 AS w, event_id * 31 % 500 AS h FROM events)",
)
def bbox_convert(spark, sf_dir):
    box = F.array(*[F.col("event_id") * f % 500 for f in (13, 17, 29, 31)])
    text = lambda b: F.array_join(b.cast("array<string>"), ",")
    return Tables(spark, sf_dir).events.select(
        "event_id",
        text(geo.box_convert(box, "xywh")).alias("from_xywh"),
        text(geo.box_convert(box, "yyxx")).alias("from_yyxx"),
    )


def _heat(x: str, y: str) -> str:
    """Float-precision heat of a point at pixel (i, j)."""
    dx, dy = f"(i - CAST({x} AS FLOAT))", f"(j - CAST({y} AS FLOAT))"
    return f"CAST(exp(CAST(-({dx} * {dx} + {dy} * {dy}) / CAST(18.0 AS FLOAT) AS DOUBLE)) AS FLOAT)"


def _pixel(value: str) -> str:
    return f"CAST({value} / 1000 * 63 AS FLOAT)"


HEAT_POINTS = ", ".join(f"{_pixel(_s(a))} AS gx{k}, {_pixel(_s(b))} AS gy{k}" for k, (a, b) in enumerate(GT))


@query(
    "heatmap_auc",
    f"WITH p AS (SELECT event_id, event_type AS grp, CASE WHEN value >= 2 THEN {_pixel(f'(CASE WHEN value < 10 THEN {_s(13)} ELSE {_s(37)} END)')} END AS px, "
    f"{_pixel(f'(CASE WHEN value < 10 THEN {_s(17)} ELSE {_s(91)} END)')} AS py, {HEAT_POINTS} FROM events), "
    "g AS (SELECT CAST(i AS FLOAT) AS i, CAST(j AS FLOAT) AS j FROM range(64) a(i), range(64) b(j)), "
    f"h AS (SELECT event_id, grp, coalesce({_heat('px', 'py')}, CAST(0 AS FLOAT)) AS s, {' + '.join(_heat(f'gx{k}', f'gy{k}') for k in range(3))} AS t FROM p, g), "
    "m AS (SELECT event_id, max(t) AS peak FROM h GROUP BY event_id), "
    "c AS (SELECT event_id, grp, s, count(*) FILTER (WHERE t / peak >= 0.5) AS pos, count(*) FILTER (WHERE t / peak < 0.5) AS neg FROM h JOIN m USING (event_id) GROUP BY event_id, grp, s), "
    "r AS (SELECT *, sum(neg) OVER (PARTITION BY event_id ORDER BY s) AS cn FROM c), "
    "a AS (SELECT event_id, grp, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY event_id, grp), "
    "wide AS (SELECT grp, avg(auc) AS v, count(*) AS n FROM a GROUP BY grp) " + unpivot("wide", ["grp"], {"auc": "v"}),
)
def heatmap_auc(spark, sf_dir):
    rows = _points(Tables(spark, sf_dir)).select("grp", "gt", F.col("pred"))
    return scores(loc.heatmap_auc(rows, ["grp"]))
