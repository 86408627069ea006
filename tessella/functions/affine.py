"""Affine transforms ``struct<a,b,c,d,e,f>`` (pixel to coordinates) and UTM zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.box import box


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)])


def forward(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"]


def inverse(t: Column) -> Column:
    """The transform back; null where the given one is singular."""
    det = F.nullif(t["a"] * t["e"] - t["b"] * t["d"], F.lit(0.0))
    a, b, d, e = t["e"] / det, -t["b"] / det, -t["d"] / det, t["a"] / det
    return affine(a, b, -(t["c"] * a + t["f"] * b), d, e, -(t["c"] * d + t["f"] * e))


def apply_ring(t: Column, ring: Column) -> Column:
    """Transform every vertex of a ring of ``struct<x,y>``."""
    return F.transform(ring, lambda p: F.struct(*[c.alias(n) for c, n in zip(forward(t, p["x"], p["y"]), "xy", strict=True)]))


def apply_box(t: Column, b: Column) -> Column:
    """Bounds of the transformed corners."""
    corners = [forward(t, b[x], b[y]) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    xs, ys = zip(*corners, strict=True)
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def scale(t: Column, by: float) -> Column:
    """The transform of a raster resampled by a factor: pixels grow as the factor shrinks."""
    return affine(t["a"] / by, t["b"] / by, t["c"], t["d"] / by, t["e"] / by, t["f"])


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326xx north of the equator, 327xx south of it."""
    zone = (F.when((lon + 180) / 6 >= 0, F.floor((lon + 180) / 6)).otherwise(F.ceil((lon + 180) / 6)) + 1).cast("int")
    return F.when(lat >= 0, 32600).otherwise(32700) + zone
