"""Geometry as Column expressions.

A quad is an array of four structs (x, y) in the order top left, top right, bottom
right, bottom left. Everything here stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The quad of an axis-aligned box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def _next(points: Column) -> Column:
    """Each point's successor around the polygon."""
    return F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def area(points: Column) -> Column:
    """The absolute shoelace area."""
    return F.abs(_sum(F.zip_with(points, _next(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2


def perimeter(points: Column) -> Column:
    return _sum(F.zip_with(points, _next(points), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))


def order_by_x(points: Column) -> Column:
    """Points by x; equal ones keep their order."""
    tagged = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))
    return F.transform(F.array_sort(tagged), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y")))


def order_quad(by_x: Column) -> Column:
    """Four points, by x, as a quad: in the left pair and in the right one the
    smaller y is the top; of equal ones the second point is."""
    a, b, c, d = (F.element_at(by_x, k) for k in (1, 2, 3, 4))
    left, right = b["y"] > a["y"], d["y"] > c["y"]
    return F.array(F.when(left, a).otherwise(b), F.when(right, c).otherwise(d), F.when(right, d).otherwise(c), F.when(left, b).otherwise(a))


def clockwise(points: Column) -> Column:
    return order_quad(order_by_x(points))


def clip(points: Column, width: Column, height: Column) -> Column:
    """Into [0, width - 1] x [0, height - 1], fractions cut off."""
    into = lambda v, most: F.floor(F.least(F.greatest(v, F.lit(0.0)), (most - 1).cast("double"))).cast("double")
    return F.transform(points, lambda p: F.struct(into(p["x"], width).alias("x"), into(p["y"], height).alias("y")))


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def half_away(v: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def rescale(points: Column, ratio_x: Column, ratio_y: Column, width: Column, height: Column) -> Column:
    """Map coordinates back to the frame: v / ratio, rounded, into [0, size]."""
    into = lambda v, most: F.least(F.greatest(half_away(v), F.lit(0.0)), most.cast("double"))
    return F.transform(points, lambda p: F.struct(into(p["x"] / ratio_x, width).alias("x"), into(p["y"] / ratio_y, height).alias("y")))


def edge(points: Column, a: int, b: int) -> Column:
    p, q = F.element_at(points, a + 1), F.element_at(points, b + 1)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def edge_height(points: Column) -> Column:
    """Top left to bottom left."""
    return edge(points, 0, 3)


def edge_width(points: Column) -> Column:
    """Top left to top right."""
    return edge(points, 0, 1)


def centre(points: Column) -> Column:
    mean = lambda axis: _sum(F.transform(points, lambda p: p[axis])) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def extent(points: Column, axis: str) -> Column:
    """(least, largest) along an axis."""
    values = F.transform(points, lambda p: p[axis])
    return F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))


def vertical_extent(points: Column) -> Column:
    e = extent(points, "y")
    return e["hi"] - e["lo"]


def overlap_of_boxes(a: Column, b: Column) -> Column:
    """The shared part of the smaller of two axis-aligned boxes (structs with x0,
    y0, x1, y1): intersection / (least area + 1e-6)."""
    size = lambda s: (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    return w * h / (F.least(size(a), size(b)) + 1e-6)


def holds_point(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    """Whether a rectangle holds a point, its far edges excluded. The point's
    coordinates are rounded first, halves to even."""
    rx, ry = F.rint(px), F.rint(py)
    return (rx >= x) & (rx < x + w) & (ry >= y) & (ry < y + h)


def inside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a non-empty rectangle lies in a frame."""
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def unclip_distance(points: Column, ratio: Column) -> Column:
    """How far a polygon grows: area * ratio / perimeter, nothing for a point."""
    p = perimeter(points)
    return F.when(p > 0, area(points) * ratio / p).otherwise(0.0)


def unclip_box(x0: Column, y0: Column, x1: Column, y1: Column, ratio: Column) -> Column:
    """An axis-aligned box grown by its unclip distance. The corners lose their
    fractions first. This closed form is the bounding box of the rounded offset
    polygon, whose integer corners may differ by one pixel."""
    d = unclip_distance(quad(x0, y0, x1, y1), ratio)
    cut = lambda v: v.cast("long")
    return F.struct((cut(x0) - d).alias("x0"), (cut(y0) - d).alias("y0"), (cut(x1) + d).alias("x1"), (cut(y1) + d).alias("y1"))


def crop_size(points: Column) -> Column:
    """(width, height) of an upright crop: the longer of each pair of opposite edges."""
    return F.struct(F.floor(F.greatest(edge(points, 0, 1), edge(points, 2, 3))).cast("int").alias("width"), F.floor(F.greatest(edge(points, 0, 3), edge(points, 1, 2))).cast("int").alias("height"))


def is_rotated(width: Column, height: Column, ratio: float) -> Column:
    """Whether a crop is turned by 90 degrees: tall by at least this ratio."""
    return F.coalesce((width > 0) & (height / width >= ratio), F.lit(False))


def letterbox_width(width: Column, height: Column, rec_height: int, rec_width: int) -> Column:
    """The width of a crop in the recogniser's input."""
    return F.least(F.greatest(F.ceil(rec_height * width / F.greatest(height, F.lit(1))), F.lit(1)), F.lit(rec_width)).cast("int")


def widen(x: Column, y: Column, w: Column, h: Column, margin: Column, width: Column, height: Column) -> Column:
    """A region with its margin, cut at the frame, and the region relative to it."""
    x0, y0 = F.greatest(x - margin, F.lit(0)), F.greatest(y - margin, F.lit(0))
    x1, y1 = F.least(x + w + margin, width), F.least(y + h + margin, height)
    outer = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    keep = F.struct((x - x0).alias("x"), (y - y0).alias("y"), w.alias("width"), h.alias("height"))
    return F.struct(outer.alias("outer"), keep.alias("keep"))
