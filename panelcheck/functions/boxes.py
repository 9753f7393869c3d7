"""Box arithmetic on columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h


def box(prefix: str = "", w: str = "w", h: str = "h") -> Box:
    return Box(*[F.col(prefix + c) for c in ("x", "y", w, h)])


def overlap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x)) * F.greatest(
        zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    )


def iou(a: Box, b: Box) -> Column:
    inter = overlap(a, b)
    union = a.w * a.h + b.w * b.h - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def inside_ratio(outer: Box, inner: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    area = inner.w * inner.h
    return F.when(area != 0, overlap(outer, inner) / area).otherwise(0.0)


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.right, b.right) - x, F.greatest(a.bottom, b.bottom) - y)


def padded(a: Box, by: float) -> Box:
    return Box(a.x - by, a.y - by, a.w + 2 * by, a.h + 2 * by)


def clipped(a: Box, width: Column, height: Column) -> Box:
    """Inside the image; a box left without area has null sides."""
    zero = F.lit(0.0)
    left, top = F.greatest(zero, F.least(width, a.x)), F.greatest(zero, F.least(height, a.y))
    right, bottom = F.greatest(left, F.least(width, a.right)), F.greatest(top, F.least(height, a.bottom))
    ok = (right > left) & (bottom > top)
    return Box(*[F.when(ok, v) for v in (left, top, right - left, bottom - top)])


def gaps(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """Horizontal, vertical and diagonal distance; zero where they overlap on an axis."""
    dx = F.greatest(a.x - b.right, b.x - a.right, F.lit(0.0))
    dy = F.greatest(a.y - b.bottom, b.y - a.bottom, F.lit(0.0))
    return dx, dy, F.hypot(dx, dy)


def to_percent(a: Box, width: Column, height: Column) -> Box:
    return Box(a.x * 100 / width, a.y * 100 / height, a.w * 100 / width, a.h * 100 / height)


def to_pixels(a: Box, width: Column, height: Column) -> Box:
    return Box(a.x * width / 100, a.y * height / 100, a.w * width / 100, a.h * height / 100)


def named(a: Box, prefix: str = "", w: str = "w", h: str = "h") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(a, ("x", "y", w, h))]


def scaled_to_pixels(box_2d: Column, width: Column, height: Column) -> Column:
    """[ymin, xmin, ymax, xmax] on a 0-1000 scale -> struct(x, y, w, h) in pixels; null for bad input."""
    v = lambda i: F.get(box_2d, i).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = (F.size(box_2d) == 4) & finite(v(0)) & finite(v(1)) & finite(v(2)) & finite(v(3))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c))
    x0, x1 = clip(F.least(v(1), v(3))), clip(F.greatest(v(1), v(3)))
    y0, y1 = clip(F.least(v(0), v(2))), clip(F.greatest(v(0), v(2)))
    size = lambda d, side: F.greatest(F.lit(1.0), F.round(d / 1000.0 * side, 1))
    bounded = lambda c, hi: F.greatest(F.lit(0.0), F.least(hi, c))
    x = bounded(F.round(x0 / 1000.0 * width, 1), (width - 1).cast("double"))
    y = bounded(F.round(y0 / 1000.0 * height, 1), (height - 1).cast("double"))
    w = F.greatest(F.lit(1.0), F.least(width - x, size(x1 - x0, width)))
    h = F.greatest(F.lit(1.0), F.least(height - y, size(y1 - y0, height)))
    return F.when(ok, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def canonical_polygon(x: Column, y: Column, w: Column, h: Column, polygon: Column) -> Column:
    """Four points clockwise from the top left; the box's corners where no polygon is given."""
    p = lambda a, b: F.array(a, b)
    points = F.coalesce(polygon, F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)))
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda acc, q: acc + q[i]) / 4
    cx, cy = mean(0), mean(1)
    turned = F.transform(
        F.array_sort(F.transform(points, lambda q, i: F.struct(F.atan2(q[1] - cy, q[0] - cx).alias("a"), i.alias("i"), q.alias("q")))),
        lambda e: e["q"],
    )
    first = F.array_min(F.transform(turned, lambda q, i: F.struct(q[1].alias("y"), q[0].alias("x"), i.alias("i"))))["i"]
    return F.concat(F.slice(turned, first + 1, F.lit(4)), F.slice(turned, F.lit(1), first))


def unmapped_point(x: Column, y: Column, transforms: Column) -> Column:
    """A point through the inverse of resize, rotation and perspective steps, last step first.

    ``transforms``: array of struct(type, scale, matrix) with the matrix row by
    row (six numbers for a rotation, nine for a perspective).
    """

    def back(p: Column, t: Column) -> Column:
        m = lambda i: F.get(t["matrix"], i)
        det = m(0) * m(4) - m(1) * m(3)
        dx, dy = p["x"] - m(2), p["y"] - m(5)
        rotated = F.struct(((m(4) * dx - m(1) * dy) / det).alias("x"), ((m(0) * dy - m(3) * dx) / det).alias("y"))
        # adjugate of the 3x3 matrix; its scale cancels in the division
        u = (m(4) * m(8) - m(5) * m(7)) * p["x"] + (m(2) * m(7) - m(1) * m(8)) * p["y"] + (m(1) * m(5) - m(2) * m(4))
        v = (m(5) * m(6) - m(3) * m(8)) * p["x"] + (m(0) * m(8) - m(2) * m(6)) * p["y"] + (m(2) * m(3) - m(0) * m(5))
        q = (m(3) * m(7) - m(4) * m(6)) * p["x"] + (m(1) * m(6) - m(0) * m(7)) * p["y"] + (m(0) * m(4) - m(1) * m(3))
        flat = F.struct((u / q).alias("x"), (v / q).alias("y"))
        sized = F.struct((p["x"] / t["scale"]).alias("x"), (p["y"] / t["scale"]).alias("y"))
        return F.when(t["type"] == "rotation", rotated).when(t["type"] == "perspective", flat).when(t["type"] == "resize", sized).otherwise(p)

    return F.aggregate(F.reverse(transforms), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), back)


def map_polygon(polygon: Column, transforms: Column, width: Column, height: Column, digits: int = 1) -> Column:
    """A polygon back in source pixels, clipped to the image."""
    edge = lambda c, side: F.round(F.least(F.greatest(c, F.lit(0.0)), F.greatest(side - 1, F.lit(0)).cast("double")), digits)
    moved = F.transform(polygon, lambda q: unmapped_point(q[0], q[1], transforms))
    return F.transform(moved, lambda p: F.array(edge(p["x"], width), edge(p["y"], height)))
