"""Coordinates, boxes and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.binding import strip

# All coordinates live on a 0..1000 grid.
GRID = 1000


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.bround(value.cast("double"), 0)


def norm1000(value: Column, size: Column | float, mode: str = "clamp") -> Column:
    """Map a pixel coordinate to the 0..1000 grid.

    Modes: ``clamp`` rounds and clamps, ``round`` only rounds, ``truncate``
    cuts the fraction and clamps, ``unit`` takes input already in [0, 1].
    """
    value = value.cast("double")
    if mode == "unit":
        return half_even(value * GRID).cast("int")
    scaled = value / (size if isinstance(size, Column) else F.lit(float(size))) * GRID
    if mode == "round":
        return half_even(scaled).cast("int")
    whole = {"clamp": half_even(scaled), "truncate": scaled}[mode].cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(GRID), whole))


def denorm(value: Column, size: Column | float) -> Column:
    """Map a grid coordinate back to pixels."""
    return half_even(value / GRID * size).cast("int")


def norm_box(box: Column, width: Column | float, height: Column | float, mode: str = "clamp") -> Column:
    """Map an x1,y1,x2,y2 pixel box to the grid."""
    return F.array(*[norm1000(box[i], height if i % 2 else width, mode) for i in range(4)])


def box_convert(box: Column, layout: str) -> Column:
    """Reorder a box to x1,y1,x2,y2 from ``xywh`` or ``yyxx`` (ymin, ymax, xmin, xmax)."""
    if layout == "xywh":
        return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])
    if layout == "yyxx":
        return F.array(box[2], box[0], box[3], box[1])
    return box


def box_center(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)


def point_of(answer: Column) -> Column:
    """A predicted point; four numbers are read as a box and replaced by its centre."""
    return F.when(F.size(answer) == 4, box_center(answer)).otherwise(
        F.array(answer[0].cast("double"), answer[1].cast("double"))
    )


def distance(a: Column, b: Column) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


def direction(origin: Column, target: Column) -> Column:
    """Unit vector from origin to target; the zero vector when they coincide."""
    dx, dy = target[0] - origin[0], target[1] - origin[1]
    length = F.sqrt(dx * dx + dy * dy)
    near = length < 1e-8
    return F.array(F.when(near, 0.0).otherwise(dx / length), F.when(near, 0.0).otherwise(dy / length))


def angle_between(u: Column, v: Column) -> Column:
    """Angle in degrees between two unit vectors."""
    dot = u[0] * v[0] + u[1] * v[1]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def box_area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, box[2] - box[0]) * F.greatest(zero, box[3] - box[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; inverted boxes have no area, an empty union gives 0."""
    overlap = F.array(
        F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    )
    shared = box_area(overlap)
    union = box_area(a) + box_area(b) - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def resolve_pair(pair: Column, items: Column) -> Column:
    """The two items named by 1-based numbers in ``"i j"``; NULL when either is missing."""
    numbers = F.transform(F.split(strip(pair), r"\s+"), lambda p: p.try_cast("int"))
    at = lambda i: F.when(numbers[i] > 0, F.try_element_at(items, numbers[i]))
    return F.when(at(0).isNotNull() & at(1).isNotNull(), F.array(at(0), at(1)))
