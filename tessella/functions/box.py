"""Axis-aligned boxes as ``struct<minx,miny,maxx,maxy>``: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(minx, miny, maxx, maxy) -> Column:
    parts = zip((minx, miny, maxx, maxy), ("minx", "miny", "maxx", "maxy"), strict=True)
    return F.struct(*[(c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)).alias(n) for c, n in parts])


def width(b: Column) -> Column:
    return b["maxx"] - b["minx"]


def height(b: Column) -> Column:
    return b["maxy"] - b["miny"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centroid(b: Column) -> tuple[Column, Column]:
    return (b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes share a point."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def overlaps(a: Column, b: Column) -> Column:
    """Boxes share an area."""
    return (a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"])


def contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["miny"] <= b["miny"]) & (a["maxx"] >= b["maxx"]) & (a["maxy"] >= b["maxy"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    """The point lies inside, not on the border."""
    return (b["minx"] < x) & (x < b["maxx"]) & (b["miny"] < y) & (y < b["maxy"])


def intersection(a: Column, b: Column) -> Column:
    """The common box; its sides are negative where there is none."""
    return box(F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]), F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"]))


def intersection_area(a: Column, b: Column) -> Column:
    x = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    y = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(x, x * 0) * F.greatest(y, y * 0)


def union_area(boxes: Column) -> Column:
    """Area that an array of boxes covers, in double: the strips between their sides, and in each the merged heights."""
    sides = F.array_sort(F.array_distinct(F.concat(boxes["minx"], boxes["maxx"])))
    by_y = F.array_sort(F.transform(boxes, lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("miny", "maxy", "minx", "maxx")])))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)

    def height(rows: Column, left: Column, right: Column) -> Column:
        def step(s, r):
            low = F.greatest(s["top"], r["miny"])
            return F.struct(F.greatest(s["top"], r["maxy"]).alias("top"), (s["sum"] + F.greatest(r["maxy"] - low, zero)).alias("sum"))

        inside = F.filter(rows, lambda r: (r["minx"] <= left) & (r["maxx"] >= right))
        return F.aggregate(inside, F.struct(none.alias("top"), zero.alias("sum")), step)["sum"]

    def total(rows: Column) -> Column:
        def step(s, x):
            x = x.cast("double")
            strip = F.when(s["last"] < x, (x - s["last"]) * height(rows, s["last"], x)).otherwise(zero)
            return F.struct(x.alias("last"), (s["sum"] + strip).alias("sum"))

        return F.aggregate(sides, F.struct(none.alias("last"), zero.alias("sum")), step)["sum"]

    return F.transform(F.array(by_y), total)[0]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null for two empty boxes."""
    common = intersection_area(a, b)
    return F.try_divide(common, area(a) + area(b) - common)


def ioa(a: Column, b: Column) -> Column:
    """The share of ``b`` that ``a`` covers; null for an empty ``b``."""
    return F.try_divide(intersection_area(a, b), area(b))


def translate(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["minx"] + dx, b["miny"] + dy, b["maxx"] + dx, b["maxy"] + dy)


def inset(b: Column, by: Column) -> Column:
    return box(b["minx"] + by, b["miny"] + by, b["maxx"] - by, b["maxy"] - by)


def exterior_distance(b: Column) -> Column:
    """Distance from the centroid to the nearest side."""
    return F.least(width(b), height(b)) / 2


def to_ring(b: Column) -> Column:
    """Closed ring of the box, counter-clockwise from the lower right."""
    p = lambda x, y: F.struct(b[x].cast("double").alias("x"), b[y].cast("double").alias("y"))
    return F.array(p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"), p("maxx", "miny"))
