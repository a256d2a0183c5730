"""Boxes and polygons as Column expressions. A polygon is an array of points, a point an array of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _xy(polygon: Column, i: int) -> tuple[Column, Column]:
    return polygon[i][0], polygon[i][1]


def _distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def dimensions(polygon: Column) -> Column:
    """The mean lengths of opposite edges as struct<width, height>; zeros for fewer than four points."""
    p = [_xy(polygon, i) for i in range(4)]
    whole = F.size(polygon) >= 4
    width, height = (_distance(p[0], p[1]) + _distance(p[3], p[2])) / 2, (_distance(p[0], p[3]) + _distance(p[1], p[2])) / 2
    return F.struct(F.when(whole, width).otherwise(0.0).alias("width"), F.when(whole, height).otherwise(0.0).alias("height"))


def between(polygon: Column, low: Column, high: Column, pad_x: Column | float = 0.0, pad_y: Column | float = 0.0) -> Column:
    """The part of a quadrilateral from one share of its writing direction to another, with padding along both axes."""
    pad_x, pad_y = (x if isinstance(x, Column) else F.lit(x) for x in (pad_x, pad_y))
    share = pad_x / F.greatest(dimensions(polygon)["width"], F.lit(1.0))
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), low - share))
    high = F.greatest(low, F.least(F.lit(1.0), high + share))
    corner = [_xy(polygon, i) for i in range(4)]

    def edge(ratio: Column) -> tuple[Column, Column]:
        top = [corner[0][k] + (corner[1][k] - corner[0][k]) * ratio for k in (0, 1)]
        bottom = [corner[3][k] + (corner[2][k] - corner[3][k]) * ratio for k in (0, 1)]
        length = F.hypot(bottom[0] - top[0], bottom[1] - top[1])
        step = [F.when(length > 1e-6, (bottom[k] - top[k]) / length * pad_y).otherwise(0.0) for k in (0, 1)]
        return F.array(*[top[k] - step[k] for k in (0, 1)]), F.array(*[bottom[k] + step[k] for k in (0, 1)])

    (t0, b0), (t1, b1) = edge(low), edge(high)
    return F.when(F.size(polygon) < 4, polygon).otherwise(F.array(t0, t1, b1, b0))


def clip(polygon: Column, width: Column, height: Column) -> Column:
    """A polygon with its points moved into an image; unchanged where the size is null."""
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least((size - 1).cast("double"), v.cast("double")))
    moved = F.transform(polygon, lambda p: F.array(inside(p[0], width), inside(p[1], height)))
    return F.when(width.isNull() | height.isNull(), polygon).otherwise(moved)


def rectangle(box: Column) -> Column:
    """The bounding box of a polygon as struct<x1, y1, x2, y2>."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 if their union is empty."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(zero, r["x2"] - r["x1"]) * F.greatest(zero, r["y2"] - r["y1"])
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def padding(height: Column, strict: bool, least_x: float = 0.0, least_y: float = 0.0, unsure: Column | None = None) -> tuple[Column, Column]:
    """Padding by the height of a line: wider in the strict mode, and more so where a mapping is unsure."""
    x = F.when(unsure if unsure is not None else F.lit(False), 0.20).otherwise(0.12) if strict else F.lit(0.08)
    y = 0.08 if strict else 0.05
    return F.greatest(height * x, F.lit(least_x)), F.greatest(height * y, F.lit(least_y))
