"""Blends of several prediction scores into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.box import centroid, height, width


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")


def _parts(weights: dict[str, float]) -> list[tuple[Column, float]]:
    check_weights(weights)
    return [(F.coalesce(F.col(c), F.lit(0.0)), w) for c, w in weights.items()]


def arithmetic(weights: dict[str, float]) -> Column:
    """Weighted mean; a missing score counts as 0."""
    return reduce(Column.__add__, [s * w for s, w in _parts(weights)])


def geometric(weights: dict[str, float]) -> Column:
    return F.pow(reduce(Column.__mul__, [F.pow(s, F.lit(w)) for s, w in _parts(weights)]), F.lit(1 / sum(weights.values())))


def harmonic(weights: dict[str, float]) -> Column:
    return F.lit(sum(weights.values())) / reduce(Column.__add__, [F.lit(w) / (s + 1e-12) for s, w in _parts(weights)])


BLENDS = {"weighted_arithmetic_mean": arithmetic, "weighted_geometric_mean": geometric, "weighted_harmonic_mean": harmonic}


def centroid_weight(shape: Column, tile: Column, weight: float) -> Column:
    """1 at the tile's centre, falling with the distance over the tile's whole diagonal."""
    (x, y), (cx, cy) = centroid(shape), centroid(tile)
    far = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    return 1 - F.try_divide(far, F.sqrt(width(tile) * width(tile) + height(tile) * height(tile))) * (1 - weight)
