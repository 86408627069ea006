"""Boolean operations on polygons given as sets of rings (even-odd): the edges that bound the result, walked into rings.

Edges are split where they meet; a piece stays if the result lies on one side of it only,
directed so that it lies on the left. Exteriors come out counter-clockwise, holes clockwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import ring_area
from tessella.functions.slabs import _chunks, _repeated, pair_areas, ring_edges

Rings = list[np.ndarray]
MOST_CORNERS = 512  # of a ring whose edges are compared pair by pair
_MATRIX = 1 << 18  # pairs of edges and ends that are compared at once


def _edges(rings: Rings) -> np.ndarray:
    """n x 2 x 2: start and end points."""
    parts = [np.stack([r, np.roll(r, -1, axis=0)], axis=1) for r in rings if len(r) > 2]
    return np.concatenate(parts) if parts else np.empty((0, 2, 2))


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd membership of points."""
    if not len(edges):
        return np.zeros(len(points), bool)
    (x0, y0), (x1, y1) = edges[:, 0].T, edges[:, 1].T
    px, py = points[:, :1], points[:, 1:]
    spans = (y0 <= py) != (y1 <= py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (py - y0) * (x1 - x0) / (y1 - y0)
    return (spans & (px < at)).sum(axis=1) % 2 == 1


def _split(edges: np.ndarray, grain: float) -> np.ndarray:
    """Edges cut at every meeting with another, ends snapped to the grain, each piece once."""
    d = edges[:, 1] - edges[:, 0]
    length = (d * d).sum(axis=1)
    edges, d, length = edges[length > 0], d[length > 0], length[length > 0]
    n = len(edges)
    owners, cuts = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
    ends = edges.reshape(-1, 2)
    for a in range(0, n, step := max(1, _MATRIX // max(1, 2 * n))):
        p, v, size = edges[a : a + step, :1], d[a : a + step, None], length[a : a + step, None]
        w = edges[None, :, 0] - p
        cross = v[..., 0] * d[:, 1] - v[..., 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[..., 0] * d[:, 1] - w[..., 1] * d[:, 0]) / cross
            s = (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / cross
        crossing = (np.abs(cross) > 1e-12 * size) & (s >= -1e-9) & (s <= 1 + 1e-9) & (t > 0) & (t < 1)
        # ends of other edges that lie on this one, which covers edges along it
        off = ends - p
        along = (off * v).sum(axis=2) / size
        near = (np.abs(off[..., 0] * v[..., 1] - off[..., 1] * v[..., 0]) <= grain * np.sqrt(size)) & (along > 0) & (along < 1)
        for found, at in ((crossing, t), (near, along)):
            i, _ = np.nonzero(found)
            owners.append(i + a)
            cuts.append(at[found])
    owner, cut = np.concatenate(owners), np.concatenate(cuts)
    order = np.lexsort([cut, owner])
    owner, cut = owner[order], cut[order]
    points = np.rint((edges[owner, 0] + cut[:, None] * d[owner]) / grain).astype(np.int64)
    pieces = np.concatenate([points[:-1], points[1:]], axis=1)[owner[1:] == owner[:-1]]
    turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[turned] = pieces[turned][:, [2, 3, 0, 1]]
    pieces = pieces[(pieces[:, :2] != pieces[:, 2:]).any(axis=1)]
    return np.unique(pieces, axis=0).astype(float).reshape(-1, 2, 2) * grain


def _walk(edges: np.ndarray, grain: float) -> Rings:
    """Directed edges as rings; where several go on, the sharpest right turn keeps regions apart."""
    ways: dict[tuple, list[tuple]] = {}
    for a, b in np.rint(edges / grain).astype(np.int64).tolist():
        ways.setdefault(tuple(a), []).append(tuple(b))
    rings = []
    while ways:
        start = min(ways)
        ring, at, last = [start], start, None
        while True:
            options = ways[at]
            if last is not None and len(options) > 1:
                back = np.arctan2(last[1] - at[1], last[0] - at[0])
                to = max(options, key=lambda o, at=at, back=back: (np.arctan2(o[1] - at[1], o[0] - at[0]) - back) % (2 * np.pi))
            else:
                to = options[0]
            options.remove(to)
            if not options:
                del ways[at]
            last, at = at, to
            if at == start or at not in ways:
                break
            ring.append(at)
        out = np.array(ring, float) * grain
        if len(out) > 2:
            rings.append(out)
    return rings


def combined(parts: list[Rings], keep: Callable[[list[np.ndarray]], np.ndarray], grain: float | None = None) -> Rings:
    """Rings of the points for which ``keep([in parts[0], in parts[1], ...])`` holds; corners are multiples of ``grain``."""
    own = [_edges(p) for p in parts]
    every = np.concatenate([np.empty((0, 2, 2)), *own])
    if not len(every):
        return []
    if grain is None:
        extent = float(np.ptp(every.reshape(-1, 2), axis=0).max())
        grain = 2.0 ** np.floor(np.log2(max(extent, 1e-300) * 1e-9))
    pieces = _split(every, grain)
    if not len(pieces):
        return []
    d = pieces[:, 1] - pieces[:, 0]
    normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    middle, step = pieces.mean(axis=1), 8 * grain
    sides = [keep([inside(middle + k * step * normal, e) for e in own]) for k in (1, -1)]
    bounds = np.concatenate([pieces[sides[0] & ~sides[1]], pieces[sides[1] & ~sides[0]][:, ::-1]])
    return _walk(bounds, grain)


def combined_many(groups: list[list[Rings]], keep: Callable[[np.ndarray, np.ndarray], np.ndarray], grain: float | None = None) -> list[Rings]:
    """``combined`` for many groups of parts at once; ``keep`` gets membership in the first part and in any of the others."""
    found = [(g, k, r) for g, parts in enumerate(groups) for k, p in enumerate(parts) for r in p if len(r) > 2]
    out: list[Rings] = [[] for _ in groups]
    if not found:
        return out
    edges, ring = ring_edges(np.concatenate([r for _, _, r in found]), np.array([len(r) for _, _, r in found]))
    group, part = (np.array([f[i] for f in found])[ring] for i in (0, 1))
    low, high = np.full((len(groups), 2), np.inf), np.full((len(groups), 2), -np.inf)
    np.minimum.at(low, group, edges[:, :2])
    np.maximum.at(high, group, edges[:, :2])
    with np.errstate(invalid="ignore"):
        extent = np.nan_to_num(high - low, neginf=0.0).max(axis=1)
    grains = np.full(len(groups), grain) if grain is not None else 2.0 ** np.floor(np.log2(np.maximum(extent, 1e-300) * 1e-9))
    starts = np.searchsorted(group, np.arange(len(groups) + 1))
    work = 4 * np.diff(starts) ** 2
    total = np.cumsum(work)
    a = 0
    while a < len(groups):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 4 * _MATRIX, side="right")))
        s = slice(starts[a], starts[b])
        if work[a] > 4 * _MATRIX:  # alone: its pairs are compared in steps
            out[a] = combined(groups[a], lambda sides: keep(sides[0], np.logical_or.reduce([np.zeros(len(sides[0]), bool), *sides[1:]])), grain)
        elif s.start < s.stop:
            out[a:b] = _combined_chunk(edges[s].reshape(-1, 2, 2), group[s] - a, part[s], keep, grains[a:b], extent[a:b])
        a = b
    return out


def _combined_chunk(edges: np.ndarray, group: np.ndarray, part: np.ndarray, keep: Callable, grain: np.ndarray, extent: np.ndarray) -> list[Rings]:
    """The rings of each group, from edges that stand group by group; the steps are those of ``combined``."""
    bounds, of_group = _split_many(edges, group, grain, extent)
    d = bounds[:, 1] - bounds[:, 0]
    normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    middle, step = bounds.mean(axis=1), 8 * grain[of_group][:, None]
    starts = np.searchsorted(group, np.arange(len(grain) + 1))
    piece, copy = _repeated(np.diff(starts)[of_group])
    edge = starts[of_group[piece]] + copy
    (x0, y0), (x1, y1) = edges[:, 0].T, edges[:, 1].T
    n_parts, sides = int(part.max()) + 1, []
    for k in (1, -1):
        px, py = (middle + k * step * normal).T
        at = py[piece]
        spans = (y0[edge] <= at) != (y1[edge] <= at)
        i, j = piece[spans], edge[spans]
        hit = px[i] < x0[j] + (py[i] - y0[j]) * (x1[j] - x0[j]) / (y1[j] - y0[j])
        odd = np.bincount(i[hit] * n_parts + part[j[hit]], minlength=len(bounds) * n_parts).reshape(-1, n_parts) % 2 == 1
        sides.append(keep(odd[:, 0], odd[:, 1:].any(axis=1)))
    ways = [sides[0] & ~sides[1], sides[1] & ~sides[0]]
    directed, owner = np.concatenate([bounds[ways[0]], bounds[ways[1]][:, ::-1]]), np.concatenate([of_group[w] for w in ways])
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(grain)))
    return [_walk(e, g) if len(e) else [] for e, g in zip(np.split(directed[order], cuts), grain.tolist(), strict=True)]


def _split_many(edges: np.ndarray, group: np.ndarray, grain: np.ndarray, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_split`` inside each group: the pieces, and the group of each."""
    d = edges[:, 1] - edges[:, 0]
    length = (d * d).sum(axis=1)
    some = length > 0
    edges, d, length, group = edges[some], d[some], length[some], group[some]
    n, grains = len(edges), grain[group]
    starts = np.searchsorted(group, np.arange(len(grain) + 1))
    i, copy = _repeated(np.diff(starts)[group])
    j = starts[group[i]] + copy
    # only edges whose boxes come near can meet
    margin = (4 * grain + 1e-8 * extent)[group][:, None]
    low, high = edges.min(axis=1) - margin, edges.max(axis=1) + margin
    near = (low[i, 0] <= high[j, 0]) & (low[j, 0] <= high[i, 0])
    i, j = i[near], j[near]
    near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
    i, j = i[near], j[near]
    p, v, size, w, u = edges[i, 0], d[i], length[i], edges[j, 0] - edges[i, 0], d[j]
    cross = v[:, 0] * u[:, 1] - v[:, 1] * u[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, 0] * u[:, 1] - w[:, 1] * u[:, 0]) / cross
        s = (w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0]) / cross
    crossing = (np.abs(cross) > 1e-12 * size) & (s >= -1e-9) & (s <= 1 + 1e-9) & (t > 0) & (t < 1)
    owners, cuts = [np.arange(n), np.arange(n), i[crossing]], [np.zeros(n), np.ones(n), t[crossing]]
    for end in (0, 1):
        off = edges[j, end] - p
        along = (off * v).sum(axis=1) / size
        on = (np.abs(off[:, 0] * v[:, 1] - off[:, 1] * v[:, 0]) <= grains[i] * np.sqrt(size)) & (along > 0) & (along < 1)
        owners.append(i[on])
        cuts.append(along[on])
    owner, cut = np.concatenate(owners), np.concatenate(cuts)
    order = np.lexsort([cut, owner])
    owner, cut = owner[order], cut[order]
    points = np.rint((edges[owner, 0] + cut[:, None] * d[owner]) / grains[owner][:, None]).astype(np.int64)
    same = owner[1:] == owner[:-1]
    pieces, of_group = np.concatenate([points[:-1], points[1:]], axis=1)[same], group[owner[1:][same]]
    turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[turned] = pieces[turned][:, [2, 3, 0, 1]]
    some = (pieces[:, :2] != pieces[:, 2:]).any(axis=1)
    pieces, of_group = pieces[some], of_group[some]
    order = np.lexsort([*pieces.T[::-1], of_group])
    pieces, of_group = pieces[order], of_group[order]
    new = np.r_[True, (pieces[1:] != pieces[:-1]).any(axis=1) | (of_group[1:] != of_group[:-1])][: len(pieces)]
    pieces, of_group = pieces[new], of_group[new]
    return pieces.astype(float).reshape(-1, 2, 2) * grain[of_group][:, None, None], of_group


def overlay(a: Rings, b: Rings, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Rings:
    """Rings of the points for which ``keep(in a, in b)`` holds."""
    return combined([a, b], lambda sides: keep(*sides))


def united(parts: list[Rings], grain: float | None = None) -> Rings:
    """The union of any number of regions."""
    return combined(parts, lambda sides: np.logical_or.reduce(sides), grain)


def intersection(a: Rings, b: Rings) -> Rings:
    return overlay(a, b, lambda x, y: x & y)


def union(a: Rings, b: Rings) -> Rings:
    return overlay(a, b, lambda x, y: x | y)


def difference(a: Rings, b: Rings) -> Rings:
    return overlay(a, b, lambda x, y: x & ~y)


def repaired(a: Rings) -> Rings:
    """The even-odd region of rings that may cross themselves."""
    return overlay(a, [], lambda x, y: x)


@dataclass
class Region:
    """A polygonal region; the same interface as ``rectilinear.Cells``."""

    rings: Rings

    @property
    def area(self) -> float:
        return sum(ring_area(r) for r in self.rings)

    def intersection_area(self, other: Region) -> float:
        return float(pair_areas([self.rings], [other.rings])[0])

    def minus(self, other: Region) -> Region:
        return Region(difference(self.rings, other.rings))

    def parts(self) -> list[Region]:
        """Each exterior with the holes inside of it."""
        outer = [r for r in self.rings if ring_area(r) > 0]
        holes = [r for r in self.rings if ring_area(r) < 0]
        out = []
        for r in outer:
            edges = _edges([r])
            out.append(Region([r, *(h for h in holes if inside(h.mean(axis=0)[None], edges)[0] or inside(h[:1], edges)[0])]))
        return out


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs ``i < j`` of the rows of each of ``sizes`` that follow one another; ``(i, j, owner, steps from i to j, least steps either way)``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, k = _repeated(sizes[owner] - place - 1)
    return i, i + 1 + k, owner[i], 1 + k, np.minimum(1 + k, sizes[owner[i]] - 1 - k)


def _edges_meet(points: np.ndarray, sizes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whether edges of each ring that don't follow one another meet, or come about ``near``."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    ends = points[first[ring] + (np.arange(len(points)) - first[ring] + 1) % sizes[ring]]
    i, j, owner, _, apart = _pairs(sizes)
    i, j, owner = (x[apart > 1] for x in (i, j, owner))
    low, high = np.minimum(points, ends), np.maximum(points, ends)
    clear = (high[i] + near[owner, None] < low[j]).any(axis=1) | (high[j] + near[owner, None] < low[i]).any(axis=1)
    i, j, owner = (x[~clear] for x in (i, j, owner))

    def beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edges ``b`` lie on one side of the lines of ``a``."""
        v, at = ends[a] - points[a], (points[b] - points[a], ends[b] - points[a])
        one, two = (v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0] for w in at)
        least = near[owner] * np.hypot(*v.T)
        return (np.minimum(one, two) > least) | (np.maximum(one, two) < -least)

    met = ~(beside(i, j) | beside(j, i))
    return np.bincount(owner[met], minlength=len(sizes)) > 0


def plain_rings(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rings of ``sizes`` corners surely don't touch themselves."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    p = points - points[first][ring]
    near = 1e-9 * np.maximum.reduceat(np.abs(p).max(axis=1), first) if len(p) else np.empty(0)
    place = np.arange(len(p)) - first[ring]
    step = p[first[ring] + (place + 1) % sizes[ring]] - p
    before = step[first[ring] + (place - 1) % sizes[ring]]
    turn = np.arctan2(before[:, 0] * step[:, 1] - before[:, 1] * step[:, 0], (before * step).sum(axis=1))
    good = (np.hypot(*step.T) > near[ring]) & (np.abs(turn) < np.pi - 1e-6)
    return (np.bincount(ring[~good], minlength=len(sizes)) == 0) & ~_edges_meet(p, sizes, near)


def single_rings(regions: pa.Array, known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the known regions are one ring of three up to ``most`` corners, with these ``(n, 2)`` and their numbers."""
    counts = regions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rings = regions.flatten()
    sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = rings.flatten().to_numpy(zero_copy_only=False).astype(float)
    first_ring, first_value = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    one = np.flatnonzero(known & (counts == 1))
    own = sizes[first_ring[one]]
    some = (own >= 6) & (own <= 2 * most) & (own % 2 == 0)
    one, own = one[some], own[some]
    at, k = _repeated(own)
    return one, values[first_value[first_ring[one]][at] + k].reshape(-1, 2), own // 2


def ring_lists(known: np.ndarray, one: np.ndarray, points: np.ndarray, sizes: np.ndarray, rest: np.ndarray, others: list[Rings]) -> pa.Array:
    """Flat rings of a batch of regions: of the regions ``one`` from ``points`` and ``sizes``, of those of ``rest`` from ``others``; null if not known."""
    of = np.concatenate([one, np.repeat(rest, [len(c) for c in others]).astype(np.int64)])
    sizes = np.concatenate([sizes, np.array([len(r) for c in others for r in c], np.int64)])
    points = np.concatenate([points, *(r for c in others for r in c)])
    order = np.argsort(of, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    at, k = _repeated(sizes[order])
    flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * sizes[order])].astype(np.int32)), pa.array(points[starts[at] + k].ravel()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(known)))].astype(np.int32)), flat, mask=pa.array(~known))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def repaired_rings(rings: pa.Array) -> pa.Array:
    """Flat rings as those of their even-odd region, holes clockwise; plain ones are turned at most."""
    known = ~np.asarray(rings.is_null())
    one, points, sizes = single_rings(rings, known, MOST_CORNERS)
    ends, plain = np.cumsum(sizes), np.zeros(len(sizes), bool)
    for a, b in _chunks(128 * sizes**2):
        plain[a:b] = plain_rings(points[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b])
    points, sizes, one = points[np.repeat(plain, sizes)], sizes[plain], one[plain]
    ring, place = _repeated(sizes)
    start = (np.cumsum(sizes) - sizes)[ring]
    p = points - points[start]
    after = p[start + (place + 1) % sizes[ring]]
    turned = np.bincount(ring, p[:, 0] * after[:, 1] - p[:, 1] * after[:, 0], len(sizes)) < 0
    points = points[np.where(turned[ring], start + sizes[ring] - 1 - place, start + place)]
    rest = np.setdiff1d(np.flatnonzero(known), one)
    regions = [[[np.asarray(f, float).reshape(-1, 2) for f in x]] for x in rings.take(pa.array(rest)).to_pylist()]
    return ring_lists(known, one, points, sizes, rest, combined_many(regions, lambda a, _: a))
