"""Regions grown or shrunk by a distance, with round corners.

An edge sweeps a rectangle on one side, a corner that turns away from that side an arc between the rectangles of its
edges; arcs are chords of a quarter circle's ``quarter`` parts. A positive distance adds what is swept outwards to the
region, a negative one takes away what is swept inwards; where sweeps overlap or meet the region they are cleaned
by membership, as in every overlay. Holes shrink where the region grows.

A plain ring whose sweeps only meet at its corners needs no cleaning: its outline is moved corner by corner, for a whole
batch at once. If sweeps end where their neighbours begin, they are an immersed band along the ring; and if the ring
and the moved outline cross neither themselves, that band covers no point twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import ring_area
from tessella.functions.overlay import Rings, _edges_meet, _pairs, combined_many, ring_lists, single_rings
from tessella.functions.slabs import _chunks, _repeated

MOST_CORNERS, MOST_POINTS = 512, 2_048  # of a ring and of its moved outline, whose edges are compared pair by pair


def _arc(at: np.ndarray, start: float, turn: float, radius: float, quarter: int) -> np.ndarray:
    """Points around ``at`` from an angle on through ``turn``, as many as the quarter's parts ask for."""
    n = max(1, int(np.ceil(abs(turn) / (np.pi / 2) * quarter - 1e-9)))
    angles = start + turn * np.arange(n + 1) / n
    return at + radius * np.stack([np.cos(angles), np.sin(angles)], axis=1)


def _swept(ring: np.ndarray, distance: float, quarter: int) -> list[np.ndarray]:
    """What the border of a ring, the region on its left, sweeps to the right (distance over 0) or to the left."""
    step = np.roll(ring, -1, axis=0) - ring
    ring, step = ring[(step != 0).any(axis=1)], step[(step != 0).any(axis=1)]
    normal = np.stack([step[:, 1], -step[:, 0]], axis=1) / np.hypot(*step.T)[:, None]  # to the right
    parts = []
    for k in range(len(ring)):
        p, q, off = ring[k], ring[(k + 1) % len(ring)], distance * normal[k]
        parts.append(np.array([p, q, q + off, p + off]))
        before = normal[k - 1]
        turn = np.arctan2(before[0] * normal[k, 1] - before[1] * normal[k, 0], before @ normal[k])
        if turn * distance > 1e-12:  # the corner opens on the swept side
            start = np.arctan2(before[1], before[0]) + (np.pi if distance < 0 else 0)
            parts.append(np.concatenate([p[None], _arc(p, start, turn, abs(distance), quarter)]))
    return parts


def buffered(rings: Rings, distance: float, quarter: int = 8) -> Rings:
    """The region within ``distance`` of a region, or, for a negative distance, the part of it that is farther from its border."""
    return buffered_many([rings], [distance], quarter)[0]


def buffered_many(regions: list[Rings], distances: list[float], quarter: int = 8) -> list[Rings]:
    """``buffered`` for each region and its distance, all at once."""
    out = combined_many([[[np.asarray(r, float).reshape(-1, 2) for r in rings]] for rings in regions], lambda a, _: a)
    for grows in (True, False):
        at = [i for i, by in enumerate(distances) if out[i] and (by > 0 if grows else by < 0)]
        parts = [[out[i], *([p] for r in out[i] if ring_area(r) for p in _swept(r, distances[i], quarter))] for i in at]
        for i, found in zip(at, combined_many(parts, np.logical_or if grows else lambda a, b: a & ~b), strict=True):
            out[i] = found
    return out


def _moved(points: np.ndarray, sizes: np.ndarray, by: np.ndarray, quarter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outlines ``(points, sizes, sure)`` of rings of ``sizes`` corners, moved by a distance; not ``sure`` where sweeps need cleaning."""
    n_rings = len(sizes)
    ring = np.repeat(np.arange(n_rings), sizes)
    first = np.cumsum(sizes) - sizes
    start, size, place = first[ring], sizes[ring], np.arange(len(points)) - first[ring]
    after, last = start + (place + 1) % size, start + (place - 1) % size
    origin = points[first]
    p = points - origin[ring]
    area = np.bincount(ring, p[:, 0] * p[after, 1] - p[after, 0] * p[:, 1], n_rings)
    p = p[np.where((area < 0)[ring], start + size - 1 - place, start + place)]
    extent = np.maximum.reduceat(np.abs(p).max(axis=1), first)
    near = 1e-9 * extent
    every = lambda good: np.bincount(ring[~good], minlength=n_rings) == 0

    d = by[ring]
    step = p[after] - p
    length = np.hypot(*step.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        normal = np.stack([step[:, 1], -step[:, 0]], axis=1) / length[:, None]  # to the right
    before = normal[last]
    cosine = (before * normal).sum(axis=1)
    turn = np.arctan2(before[:, 0] * normal[:, 1] - before[:, 1] * normal[:, 0], cosine)
    opens, closes = turn * d > 1e-12, turn * d < -1e-12
    trim = np.where(closes, np.abs(d) * np.tan(np.abs(turn) / 2), 0.0)
    # sweeps that close end on the line between them, inside of each other
    good = (length > 0) & (np.abs(turn) < np.pi - 1e-6) & (length - trim - trim[after] > near[ring])
    good &= ~closes | ((np.abs(turn) <= np.pi / 2 + 1e-9) & (np.minimum(length, length[last]) >= np.abs(d) * (1 - 1e-9)))
    n = np.where(opens, np.maximum(1, np.ceil(np.abs(turn) / (np.pi / 2) * quarter - 1e-9)), 0).astype(np.int64)
    sure = every(good) & (area != 0) & (by != 0) & ~_edges_meet(p, sizes, near)
    n_out = np.bincount(ring, n + 1, n_rings).astype(np.int64)
    sure &= n_out <= MOST_POINTS
    n[~sure[ring]] = 0  # no arcs where they aren't used
    corner, k = _repeated(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        met = p + d[:, None] * (before + normal) / (1 + cosine)[:, None]
    angle = (np.arctan2(before[:, 1], before[:, 0]) + np.where(d < 0, np.pi, 0))[corner] + turn[corner] * k / np.maximum(n, 1)[corner]
    arc = p[corner] + np.abs(d)[corner, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    out = np.where(opens[corner, None], arc, met[corner])
    n_out = np.bincount(ring, n + 1, n_rings).astype(np.int64)

    # an outline's arcs and edges in turn; only where their boxes meet all edges are compared
    begin = np.cumsum(n + 1) - (n + 1)
    end = begin + n
    low, high = np.minimum.reduceat(out, begin), np.maximum.reduceat(out, begin)
    edge = np.stack([out[end], out[begin[after]]])
    low, high = (np.stack([x, f], axis=1).reshape(-1, 2) for x, f in ((low, edge.min(axis=0)), (high, edge.max(axis=0))))
    i, j, owner, steps, apart = _pairs(2 * sizes)
    between = np.where(steps == apart, i + 1, j + 1)  # the piece between two that are two steps apart
    between = np.where(between == (2 * (first + sizes))[owner], 2 * first[owner], between)
    point = np.stack([n == 0, np.zeros(len(n), bool)], axis=1).ravel()
    apart = (apart > 2) | ((apart == 2) & ~point[between])
    i, j, owner = (x[apart] for x in (i, j, owner))
    clear = (high[i] + near[owner, None] < low[j]).any(axis=1) | (high[j] + near[owner, None] < low[i]).any(axis=1)
    doubt = sure & (np.bincount(owner[~clear], minlength=n_rings) > 0)
    whole = np.repeat(np.arange(n_rings), n_out)
    for a, b in _chunks(n_out[doubt] ** 2 // 2):
        some = np.flatnonzero(doubt)[a:b]
        sure[some] = ~_edges_meet(out[np.isin(whole, some)], n_out[some], near[some])
    x, y = out.T
    turned = np.bincount(whole, x * np.roll(y, -1) - np.roll(x, -1) * y, n_rings) if len(out) else np.zeros(n_rings)
    if len(out):  # edges that close rings
        f = np.cumsum(n_out) - n_out
        e = f + n_out - 1
        nxt = (e + 1) % len(out)
        turned += x[e] * y[f] - x[f] * y[e] - (x[e] * y[nxt] - x[nxt] * y[e])
    return out + origin[whole], n_out, sure & (turned > 0)


def _plain_moved(points: np.ndarray, sizes: np.ndarray, by: np.ndarray, quarter: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_moved`` in runs of rings so short that their pairs of edges stay in a core's cache."""
    ends = np.cumsum(sizes)
    return [_moved(points[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], by[a:b], quarter) for a, b in _chunks(128 * sizes**2)]


def _buffered_lists(regions: pa.Array, by: np.ndarray, quarter: int) -> pa.Array:
    """Flat rings of a batch of regions, each grown or shrunk by its distance (NaN: null)."""
    known = ~np.asarray(regions.is_null()) & ~np.isnan(by)
    one, points, sizes = single_rings(regions, known, MOST_CORNERS)
    found = _plain_moved(points, sizes, by[one], quarter)
    moved, m_sizes, sure = (np.concatenate([np.empty(e, t), *(f[i] for f in found)]) for i, (e, t) in enumerate((((0, 2), float), (0, np.int64), (0, bool))))
    rest = np.setdiff1d(np.flatnonzero(known), one[sure])
    cleaned = buffered_many([[np.asarray(r, float) for r in x] for x in regions.take(pa.array(rest)).to_pylist()], by[rest].tolist(), quarter)
    return ring_lists(known, one[sure], moved[np.repeat(sure, m_sizes)], m_sizes[sure], rest, cleaned)


def buffer(rings: Column | str, distance: Column | float, quarter: int = 8) -> Column:
    """Flat rings of a region given as flat rings, grown or shrunk; empty where nothing is left, null for null."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def each(regions: pa.Array, by: pa.Array) -> pa.Array:
        return _buffered_lists(regions, by.cast(pa.float64()).to_numpy(zero_copy_only=False), quarter)

    return each(rings, distance if isinstance(distance, Column) else F.lit(float(distance)))
