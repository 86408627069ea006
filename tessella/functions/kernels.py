"""Arrow kernels for what expressions can't do: clipping, rasterising and tracing of polygons.

Polygons are flat coordinate lists ``[x1, y1, ...]`` without a closing vertex; masks are run
lengths, column by column, zeros first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.slabs import _repeated, corner_areas, pair_areas, ring_edges

MOST_CORNERS = 16  # of right-angled polygons whose common area is taken by corners
_DOUBLES, _LONGS = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())


def clip_half_plane(ring: np.ndarray, axis: int, bound: float, keep_above: bool) -> np.ndarray:
    """Part of a ring (n x 2) on one side of an axis-parallel line."""
    if not len(ring):
        return ring
    v = ring[:, axis] - bound if keep_above else bound - ring[:, axis]
    nxt, w = np.roll(ring, -1, axis=0), np.roll(v, -1)
    out = []
    for p, q, a, b in zip(ring, nxt, v, w, strict=True):
        if a >= 0:
            out.append(p)
        if (a >= 0) != (b >= 0):
            cut = p + (q - p) * (a / (a - b))
            cut[axis] = bound  # exact, whatever the fraction's rounding
            out.append(cut)
    return np.array(out).reshape(-1, 2)


def clip_ring(ring: np.ndarray, b) -> np.ndarray:
    if len(ring) and (ring.min(axis=0) >= b[:2]).all() and (ring.max(axis=0) <= b[2:]).all():
        return ring
    for axis, bound, above in ((0, b[0], True), (1, b[1], True), (0, b[2], False), (1, b[3], False)):
        ring = clip_half_plane(ring, axis, bound, above)
    return ring


def clip_rings(points: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``clip_ring`` for rings of ``sizes`` vertices that follow one another in ``points (n, 2)``, each with its box ``(k, 4)``."""
    for axis, side, sign in ((0, 0, 1), (1, 1, 1), (0, 2, -1), (1, 3, -1)):
        ring = np.repeat(np.arange(len(sizes)), sizes)
        bound = boxes[ring, side]
        v = sign * (points[:, axis] - bound)
        if (v >= 0).all():
            continue
        ends, after = np.cumsum(sizes), np.arange(1, len(points) + 1)
        full = sizes > 0
        after[ends[full] - 1] = (ends - sizes)[full]
        w = v[after]
        crossed = (v >= 0) != (w >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = points + (points[after] - points) * (v / (v - w))[:, None]
        cut[:, axis] = bound  # exact, whatever the fraction's rounding
        some = np.stack([v >= 0, crossed], axis=1)
        points = np.stack([points, cut], axis=1)[some]
        sizes = np.bincount(np.repeat(ring, 2)[some.ravel()], minlength=len(sizes))
    return points, sizes


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x[:-1], y[1:]) + x[-1] * y[0] - np.dot(y[:-1], x[1:]) - y[-1] * x[0]) / 2 if len(ring) > 2 else 0.0


def intersection_area(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two polygons, read even-odd; boxes and other right-angled shapes of whole numbers are exact."""
    return float(pair_areas([[a]], [[b]])[0])


def fill_polygons(rings: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Mask of polygons on whole-pixel vertices (truncated): even-odd rows through pixel centres, and the border itself."""
    mask = np.zeros((height, width), bool)
    for ring in rings:
        p = np.trunc(ring).astype(np.int64)
        q = np.roll(p, -1, axis=0)
        inside = np.zeros((height, width), bool)
        for y in range(max(0, p[:, 1].min()), min(height, p[:, 1].max() + 1)):
            up = (p[:, 1] <= y) != (q[:, 1] <= y)
            xs = np.sort(p[up, 0] + (y - p[up, 1]) * (q[up, 0] - p[up, 0]) / (q[up, 1] - p[up, 1]))
            for s, e in zip(xs[::2], xs[1::2], strict=True):
                inside[y, max(0, int(np.ceil(s))) : max(0, int(np.floor(e)) + 1)] = True
        for s, e in zip(p, q, strict=True):  # the border is part of the shape
            n = int(np.abs(e - s).max())
            line = np.rint(s + (e - s) * (np.arange(n + 1)[:, None] / max(1, n))).astype(int)
            line = line[((line >= 0) & (line < (width, height))).all(axis=1)]
            inside[line[:, 1], line[:, 0]] = True
        mask |= inside
    return mask


def fill_runs(regions: list[list[np.ndarray] | None], width: np.ndarray, height: np.ndarray) -> list[list[int] | None]:
    """``mask_runs(fill_polygons(...))`` of each region, all at once: pixels are set in the ground of each region's own box."""
    out: list[list[int] | None] = [None if r is None else [int(w * h)] for r, w, h in zip(regions, width.tolist(), height.tolist(), strict=True)]
    rings = [(k, np.trunc(r).astype(np.int64)) for k, region in enumerate(regions) for r in region or () if len(r)]
    frame = lambda k: (int(width[k]), int(height[k]))
    # of each region the box of its pixels inside the mask
    box: dict[int, np.ndarray] = {}
    for k, r in rings:
        b = np.concatenate([np.maximum(r.min(axis=0), 0), np.minimum(r.max(axis=0) + 1, frame(k))])
        box[k] = b if k not in box else np.concatenate([np.minimum(box[k][:2], b[:2]), np.maximum(box[k][2:], b[2:])])
    live = [k for k, b in box.items() if (b[:2] < b[2:]).all()]
    if not live:
        return out
    place = {k: i for i, k in enumerate(live)}
    rings = [(place[k], r) for k, r in rings if k in place]
    b = np.array([box[k] for k in live])
    size = b[:, 2:] - b[:, :2]
    first = np.cumsum(size.prod(axis=1)) - size.prod(axis=1)
    mask = np.zeros(int(size.prod(axis=1).sum()), bool)
    at = lambda k, x, y: first[k] + (x - b[k, 0]) * size[k, 1] + y - b[k, 1]
    p = np.concatenate([r for _, r in rings])
    q = np.concatenate([np.roll(r, -1, axis=0) for _, r in rings])
    ring = np.repeat(np.arange(len(rings)), [len(r) for _, r in rings])
    region = np.array([k for k, _ in rings])[ring]
    # rows through pixel centres
    low, high = (np.clip(f(p[:, 1], q[:, 1]), b[region, 1], b[region, 3]) for f in (np.minimum, np.maximum))
    e, step = _repeated(high - low)
    y = low[e] + step
    x = p[e, 0] + (y - p[e, 1]) * (q[e, 0] - p[e, 0]) / (q[e, 1] - p[e, 1])
    order = np.lexsort([x, y, ring[e]])
    x, y, k = x[order], y[order], region[e][order]
    start = np.maximum(np.ceil(x[::2]).astype(np.int64), b[k[::2], 0])
    end = np.minimum(np.floor(x[1::2]).astype(np.int64) + 1, b[k[::2], 2])
    s, step = _repeated(np.maximum(end - start, 0))
    mask[at(k[::2][s], start[s] + step, y[::2][s])] = True
    # the border is part of the shape
    n = np.abs(q - p).max(axis=1)
    e, step = _repeated(n + 1)
    line = np.rint(p[e] + (q - p)[e] * (step / np.maximum(1, n[e]))[:, None]).astype(np.int64)
    seen = ((line >= b[region[e], :2]) & (line < b[region[e], 2:])).all(axis=1)
    mask[at(region[e][seen], *line[seen].T)] = True
    # runs inside columns, then those put together that meet at the end of a column
    column = np.repeat(np.arange(int(size[:, 0].sum())), np.repeat(size[:, 1], size[:, 0]))
    change = np.r_[True, (mask[1:] != mask[:-1]) | (column[1:] != column[:-1])]
    start = np.flatnonzero(change)
    end = np.r_[start[1:], len(mask)]
    start, end = start[mask[start]], end[mask[start]]
    k = np.searchsorted(first, start, side="right") - 1
    tall = height[live][k].astype(np.int64)
    x, y = np.divmod(start - first[k], size[k, 1])
    begin = (x + b[k, 0]) * tall + y + b[k, 1]
    close = begin + end - start
    apart = np.r_[True, (k[1:] != k[:-1]) | (begin[1:] != close[:-1])]
    last = np.r_[apart[1:], True]
    begin, close, k = begin[apart], close[last], k[apart]
    bounds = np.searchsorted(k, np.arange(len(live) + 1))
    ends = np.stack([begin, close], axis=1)
    for i, j in enumerate(live):
        w, h = frame(j)
        own = ends[bounds[i] : bounds[i + 1]].ravel()
        tail = [] if len(own) and own[-1] == w * h else [w * h]
        out[j] = np.diff(np.concatenate([[0], own, tail])).astype(np.int64).tolist()
    return out


def mask_runs(mask: np.ndarray) -> list[int]:
    flat = np.concatenate([[False], mask.T.ravel()])
    at = np.flatnonzero(flat[1:] != flat[:-1])
    return np.diff(np.concatenate([[0], at, [mask.size]])).tolist() if at.size == 0 or at[-1] < mask.size else np.diff(np.concatenate([[0], at])).tolist()


def runs_mask(runs, height: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape(-1, height).T


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Outer outlines of the regions of a mask along pixel edges, largest first; regions meet over edges, not corners."""
    height, width = mask.shape
    pad = np.pad(mask, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, a, b in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        ys, xs = np.nonzero(pad[1 : height + 1, 1 : width + 1] & ~pad[1 + dy : height + 1 + dy, 1 + dx : width + 1 + dx])
        for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
            edges.setdefault((x + a[0], y + a[1]), []).append((x + b[0], y + b[1]))
    rings = []
    while edges:
        start = min(edges)
        ring, at, last = [], start, (0, 0)
        while True:
            ways = edges[at]
            # at a corner shared by two regions turn right, so each region is walked alone
            turn = lambda to, at=at, last=last: last[0] * (to[1] - at[1]) - last[1] * (to[0] - at[0])
            to = max(ways, key=turn)
            ways.remove(to)
            if not ways:
                del edges[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != last:
                ring.append(at)
            at, last = to, step
            if at == start:
                break
        rings.append(np.array(ring, float))
    return sorted((r for r in rings if ring_area(r) > 0), key=lambda r: -ring_area(r))


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a ring: vertices nearer than the tolerance to their chord go."""
    if len(ring) < 4:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep, todo = {0, far}, [(0, far), (far, len(ring))]
    closed = np.concatenate([ring, ring[:1]])
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, part = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        n = np.hypot(*d)
        dist = np.abs(d[0] * part[:, 1] - d[1] * part[:, 0]) / n if n else np.hypot(*part.T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(k for k in keep if k < len(ring))]


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int]:
    """Largest all-set rectangle ``(minx, miny, maxx, maxy)``, ends not taken in: histogram of heights and a stack."""
    best, found = 0, (0, 0, 0, 0)
    heights = np.zeros(mask.shape[1] + 1, int)
    for y, row in enumerate(mask):
        heights[:-1] = np.where(row, heights[:-1] + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate(heights.tolist()):
            start = x
            while stack and stack[-1][1] >= h:
                start, top = stack.pop()
                if top * (x - start) > best:
                    best, found = top * (x - start), (start, y + 1 - top, x, y + 1)
            stack.append((start, h))
    return found


def _ring(flat) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, 2)


@F.pandas_udf(T.DoubleType())
def polygon_intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common area of two polygons; null where one is missing. All pairs of a batch go at once: boxes by their ends, others by slabs."""
    out = np.full(len(a), np.nan)
    four = np.array([x is not None and y is not None and len(x) == len(y) == 8 for x, y in zip(a, b, strict=True)], bool)
    if four.any():
        rings = [np.stack(s[four].to_numpy()).reshape(-1, 4, 2) for s in (a, b)]
        boxes = np.logical_and(*(((r == np.roll(r, -1, axis=1)).sum(axis=2) == 1).all(axis=1) for r in rings))
        low = np.maximum(*(r.min(axis=1) for r in rings))
        high = np.minimum(*(r.max(axis=1) for r in rings))
        at = np.flatnonzero(four)[boxes]
        out[at] = np.maximum(high - low, 0)[boxes].prod(axis=1)
    left = np.isnan(out) & a.notna().to_numpy() & b.notna().to_numpy()
    # right-angled polygons by their corners, those of equal numbers of corners at once
    sizes = np.array([(len(x), len(y)) if m else (0, 0) for x, y, m in zip(a, b, left, strict=True)], np.int64).reshape(-1, 2)
    for n, m in np.unique(sizes[left], axis=0).tolist():
        if max(n, m) <= 2 * MOST_CORNERS and min(n, m) >= 8:
            at = np.flatnonzero(left & (sizes == (n, m)).all(axis=1))
            out[at] = corner_areas(*(np.stack(s.iloc[at].to_numpy()).reshape(len(at), -1, 2) for s in (a, b)))
    rest = np.isnan(out) & a.notna().to_numpy() & b.notna().to_numpy()
    if rest.any():
        out[rest] = pair_areas(*([[x] for x in s[rest]] for s in (a, b)))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def region_intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common area of two regions given as arrays of flat rings, read even-odd (holes count out); null where one is missing."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = pair_areas(*(s[known].tolist() for s in (a, b)))
    return pd.Series(out).astype(object).where(known, None)


@F.arrow_udf(T.DoubleType())
def region_area(rings: pa.Array) -> pa.Array:
    """``polygon.rings_area`` for rings that come from Python: no row of theirs goes back for it."""
    counts = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    xy = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    edges, ring = ring_edges(xy, sizes)
    x0, y0, x1, y1 = (edges - np.tile(xy[(np.cumsum(sizes) - sizes)[ring]], 2)).T
    twice = np.bincount(ring, x0 * y1 - x1 * y0, len(sizes))
    return pa.array(np.abs(np.bincount(np.repeat(np.arange(len(rings)), counts), twice, len(rings))) / 2, mask=np.asarray(rings.is_null()))


@F.arrow_udf(_DOUBLES)
def clip_to_box(flat: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    """A polygon cut to a box; null where nothing is left. All of a batch go at once."""
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    points = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    points, sizes = clip_rings(points, sizes, np.stack([c.to_numpy(zero_copy_only=False) for c in (minx, miny, maxx, maxy)], axis=1))
    offsets = np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(points.ravel()), mask=pa.array(sizes < 3))


@F.pandas_udf(_LONGS)
def polygon_runs(parts: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Runs of the mask of a polygon's parts, borders taken in."""
    step = 1_000
    out = []
    for a in range(0, len(parts), step):
        own = [None if p is None else [_ring(x) for x in p] for p in parts[a : a + step]]
        out += fill_runs(own, *(c[a : a + step].to_numpy() for c in (width, height)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(_DOUBLES))
def runs_polygon(runs: pd.Series, height: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Simplified outlines of a mask; of several, those under 10 pixels go. An empty mask has none."""
    out = []
    for r, h, t in zip(runs, height, tolerance, strict=True):
        rings = [simplified(x, t) for x in outlines(runs_mask(r, int(h)))] if r is not None else []
        rings = [x for x in rings if len(x) > 2 and (len(rings) == 1 or ring_area(x) >= 10)]
        out.append([x.ravel().tolist() for x in rings])
    return pd.Series(out)


@F.pandas_udf(_LONGS)
def inner_rectangle(parts: pd.Series, size: pd.Series) -> pd.Series:
    """Largest rectangle inside a polygon that was normalised to a square of that size."""
    return pd.Series([None if p is None else list(largest_rectangle(fill_polygons([_ring(x) for x in p], int(s), int(s)))) for p, s in zip(parts, size, strict=True)])
