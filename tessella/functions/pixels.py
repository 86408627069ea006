"""Pixel arrays: emptiness, masks, conversion to bytes, normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty_pixel(bands: list[Column]) -> Column:
    """Black or white, or transparent where a fourth band says so; of other band counts the first band decides."""
    every = lambda of, v: reduce(Column.__and__, [b == v for b in of])
    if len(bands) == 3:
        return every(bands, 0) | every(bands, 255)
    if len(bands) == 4:
        return every(bands[:3], 0) | every(bands[:3], 255) | (bands[3] == 0)
    return (bands[0] == 0) | (bands[0] == 255)


def empty_share(bands: list[Column]) -> Column:
    """Share of empty pixels of a patch given as one array for each band; null for no pixels."""
    names = [f"b{i}" for i in range(len(bands))]
    pixels = F.arrays_zip(*[b.alias(n) for b, n in zip(bands, names, strict=True)])
    n = F.size(F.filter(pixels, lambda p: is_empty_pixel([p[c] for c in names])))
    return F.try_divide(n.cast("double"), F.size(bands[0]))


def masked(pixels: Column, mask: Column) -> Column:
    """Pixels times a 0/1 mask of the same length."""
    return F.zip_with(pixels, mask, lambda p, m: p * m)


def and_masks(a: Column, b: Column) -> Column:
    """Both masks; a missing one leaves the other."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), a, b)


def normalised(pixels: Column) -> Column:
    return F.transform(pixels, lambda p: p / F.lit(255.0))


def float_to_byte(pixels: Column) -> Column:
    """NaN and null to 255. If any value is above 1, clipped to 0-255 and truncated; else times 255 and rounded, halves to even."""
    filled = F.transform(pixels, lambda p: F.when(p.isNull() | F.isnan(p), F.lit(255.0)).otherwise(p.cast("double")))
    top = F.array_max(filled)
    return F.transform(filled, lambda p: F.floor(F.least(F.greatest(F.when(top > 1, p).otherwise(F.rint(p * 255)), F.lit(0.0)), F.lit(255.0))).cast("int"))


def wide_to_byte(pixels: Column, nodata: int | None = None) -> Column:
    """32- and 64-bit integers: nodata to 0, clipped to 16 bits and scaled to 8, truncated."""
    known = F.transform(pixels, lambda p: F.when(p.isNull() | (p == F.lit(nodata)), F.lit(0)).otherwise(p)) if nodata is not None else pixels
    return F.transform(known, lambda p: F.floor(F.least(F.greatest(p, F.lit(0)), F.lit(65535)) / F.lit(65535.0) * 255).cast("int"))


def short_to_byte(pixels: Column) -> Column:
    """Unsigned 16-bit integers: the high byte; values that fit a byte already stay."""
    return F.transform(pixels, lambda p: F.when(F.array_max(pixels) < 256, p).otherwise(F.floor(p / 256)).cast("int"))


def colour_to_byte(c: Column) -> Column:
    """16-bit point colours to 8 bits: rounded, at most 255."""
    return F.least(F.floor(c / 255 + 0.5), F.lit(255)).cast("int")
