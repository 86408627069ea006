"""Polygons as rings of ``struct<x,y>``, and their COCO coordinate lists: higher-order functions only.

A polygon part is an array of closed rings, the exterior first; a shape is an array of parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.box import box


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def to_coco(shape: Column) -> Column:
    """Flat ``[x1, y1, ...]`` for each part: exterior ring without its closing vertex."""
    return F.transform(shape, lambda part: F.flatten(F.transform(F.slice(part[0], F.lit(1), F.size(part[0]) - 1), lambda p: F.array(p["x"], p["y"]))))


def ring_of_coco(flat: Column) -> Column:
    """Closed ring of a flat coordinate list."""
    ring = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))
    return F.when(F.size(flat) >= 2, F.concat(ring, F.slice(ring, 1, 1)))


def of_coco(lists: Column) -> Column:
    """Shape of COCO coordinate lists: one part for each list."""
    return F.transform(lists, lambda flat: F.array(ring_of_coco(flat)))


def flat_area(flat: Column) -> Column:
    """Area of a polygon given as a flat coordinate list; four corners, the usual case, are read one by one."""
    x, y = ([F.get(flat, F.lit(k)) for k in range(odd, 8, 2)] for odd in (0, 1))
    four = reduce(Column.__add__, [(x[k] * y[(k + 1) % 4] - x[(k + 1) % 4] * y[k]).cast("double") for k in range(4)])
    return F.when(F.size(flat) == 8, F.abs(four) / 2).otherwise(F.abs(_twice_signed_area(ring_of_coco(flat))) / 2)


def rings_area(rings: Column) -> Column:
    """Area of flat rings of which holes turn the other way."""
    return F.abs(F.aggregate(F.transform(rings, lambda r: _twice_signed_area(ring_of_coco(r))), F.lit(0.0), lambda a, x: a + x)) / 2


def coco_bounds(lists: Column) -> Column:
    """Bounding box of COCO coordinate lists."""
    flat = lambda odd: F.flatten(F.transform(lists, lambda v: F.filter(v, lambda x, i: i % 2 == odd)))
    return box(F.array_min(flat(0)), F.array_min(flat(1)), F.array_max(flat(0)), F.array_max(flat(1)))


def flat_bounds(flat: Column) -> Column:
    """Bounding box of a polygon given as a flat coordinate list; four corners are read one by one."""
    sides = [[F.get(flat, F.lit(k)) for k in range(odd, 8, 2)] for odd in (0, 1)]
    four = box(*[f(*side) for f in (F.least, F.greatest) for side in sides])
    return F.when(F.size(flat) == 8, four).otherwise(coco_bounds(F.array(flat)))


def _twice_signed_area(ring: Column) -> Column:
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def part_area(part: Column) -> Column:
    """Exterior less holes."""
    return F.aggregate(F.transform(part, lambda r, i: F.when(i == 0, F.abs(_twice_signed_area(r))).otherwise(-F.abs(_twice_signed_area(r)))), F.lit(0.0), lambda a, v: a + v) / 2


def area(shape: Column) -> Column:
    return F.aggregate(F.transform(shape, part_area), F.lit(0.0), lambda a, v: a + v)


def ring_centroid(ring: Column) -> Column:
    """Centroid of a closed ring; null for one without area."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y", "w")])
    terms = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: F.struct(
            ((p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])).alias("x"),
            ((p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])).alias("y"),
            (p["x"] * q["y"] - q["x"] * p["y"]).alias("w"),
        ),
    )
    total = F.aggregate(terms, zero, lambda a, t: F.struct(*[(a[n] + t[n]).alias(n) for n in ("x", "y", "w")]))
    return F.transform(F.array(total), lambda s: point(F.try_divide(s["x"], 3 * s["w"]), F.try_divide(s["y"], 3 * s["w"])))[0]


def bounds(shape: Column) -> Column:
    points = F.flatten(F.transform(shape, lambda part: part[0]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def translate(shape: Column, dx: Column, dy: Column) -> Column:
    return F.transform(shape, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))))


def largest_part(shape: Column) -> Column:
    """A shape of its largest part only (the first of equal ones); null if it has none."""
    parts = F.transform(shape, lambda p, i: F.struct(part_area(p).alias("area"), (-i).alias("place"), p.alias("part")))
    return F.when(F.size(shape) > 0, F.array(F.array_max(parts)["part"]))


def single_part(shape: Column) -> Column:
    """The shape if it has one part, else null."""
    return F.when(F.size(shape) == 1, shape)


def without_rings(shape: Column) -> Column:
    return F.transform(shape, lambda part: F.slice(part, 1, 1))


def without_small_parts(shape: Column, least: float) -> Column:
    return F.filter(shape, lambda part: part_area(part) >= least)


def normalised(shape: Column, size: float = 100.0) -> Column:
    """Moved to the origin and scaled alike on both axes into a square box; see ``unnormalised``."""
    b = bounds(shape)
    by = F.lit(size) / F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"])
    return F.transform(shape, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: point((p["x"] - b["minx"]) * by, (p["y"] - b["miny"]) * by))))


def unnormalised(b: Column, original: Column, size: float = 100.0) -> Column:
    """A box in the normalised square, put back into the bounds ``original``."""
    by = F.greatest(original["maxx"] - original["minx"], original["maxy"] - original["miny"]) / size
    return box(b["minx"] * by + original["minx"], b["miny"] * by + original["miny"], b["maxx"] * by + original["minx"], b["maxy"] * by + original["miny"])


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a closed ring: parity of the edges that a ray to the right crosses."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    across = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (
        x < F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]
    )
    return F.size(F.filter(edges, across)) % 2 == 1


def shape_contains(shape: Column, x: Column, y: Column) -> Column:
    """Inside a part's exterior and outside its holes."""
    inside = lambda part: contains_point(part[0], x, y) & ~F.exists(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda r: contains_point(r, x, y))
    return F.exists(shape, inside)


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Least distance of a point from the edges of a ring."""

    def far(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(p["x"] + t * dx - x, p["y"] + t * dy - y)

    return F.array_min(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), far))
