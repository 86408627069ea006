"""Areas that regions have in common, for a whole batch of pairs at once, by slabs.

A region is a set of rings, read even-odd: holes and self-crossing rings need no care. Every edge is
a row of flat arrays. A pair's ground is cut into horizontal bands of a few edges each, a band into
slabs at the ends and crossings of its edges: inside a slab edges keep their order, so the common
ground is a row of trapezoids, whose areas are their middle widths times the height. All steps are
sorts and sums over the arrays; no loop runs over pairs, edges or slabs.
"""

from __future__ import annotations

import numpy as np

BAND_EDGES = 24  # edges that a band should hold
GROUP_EDGES = 1_024  # edges that a band of many shapes should hold
MOST_ROWS = 1 << 21  # pairs of edges, or of slabs and edges, that are held at once


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` copies of each row: the row, and which copy it is."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def ring_edges(xy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(n, 4)`` of rings of ``sizes`` vertices that follow one another in ``xy (n, 2)``, and the ring of each."""
    ends = np.cumsum(sizes)
    after = np.arange(1, len(xy) + 1)
    full = sizes > 0
    after[ends[full] - 1] = (ends - sizes)[full]
    return np.concatenate([xy, xy[after]], axis=1), np.repeat(np.arange(len(sizes)), sizes)


def _bands(edges: np.ndarray, pair: np.ndarray, side: np.ndarray, n_pairs: int) -> tuple[np.ndarray, ...]:
    """Edges, low end first, cut into the bands of their pair: ``(x0, y0, x1, y1, side, group, pair)``."""
    edges, pair, side = (x[edges[:, 1] != edges[:, 3]] for x in (edges, pair, side))  # level edges bound no slab
    turned = edges[:, 1] > edges[:, 3]
    edges[turned] = edges[turned][:, [2, 3, 0, 1]]
    low, high = np.full((2, n_pairs), np.inf), np.full((2, n_pairs), -np.inf)
    np.minimum.at(low, (side, pair), edges[:, 1])
    np.maximum.at(high, (side, pair), edges[:, 3])
    low, high = low.max(axis=0), high.min(axis=0)  # the height that both regions share
    live = (edges[:, 3] > low[pair]) & (edges[:, 1] < high[pair])
    edges, pair, side = edges[live], pair[live], side[live]
    n_bands = np.maximum(1, np.bincount(pair, minlength=n_pairs) // BAND_EDGES)
    with np.errstate(invalid="ignore"):
        step = (high - low) / n_bands
        at = lambda y: np.clip(np.floor((y - low[pair]) / step[pair]), 0, n_bands[pair] - 1).astype(np.int64)
        first, last = at(edges[:, 1]), at(edges[:, 3])
    rows, copy = _repeated(last - first + 1)
    edges, pair, side = edges[rows], pair[rows], side[rows]
    band = first[rows] + copy
    bottom = np.where(band == 0, low[pair], low[pair] + band * step[pair])
    top = np.where(band == n_bands[pair] - 1, high[pair], low[pair] + (band + 1) * step[pair])
    y0, y1 = np.maximum(edges[:, 1], bottom), np.minimum(edges[:, 3], top)
    some = y1 > y0
    first_group = np.cumsum(n_bands) - n_bands
    return edges[some], y0[some], y1[some], side[some], (first_group[pair] + band)[some], pair[some]


def _x_at(edges: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where edges are at a height between their ends, exact at the ends and on upright edges."""
    x0, y0, x1, y1 = edges.T
    x = x0 + (x1 - x0) * ((y - y0) / (y1 - y0))
    return np.where(y == y1, x1, x)


def _chunks(weights: np.ndarray) -> list[tuple[int, int]]:
    """Runs of groups whose weights sum to about MOST_ROWS."""
    total = np.cumsum(weights)
    out, a = [], 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST_ROWS, side="right")))
        out.append((a, b))
        a = b
    return out


def common_areas(edges: np.ndarray, pair: np.ndarray, side: np.ndarray, n_pairs: int) -> np.ndarray:
    """Common area of the two regions of each pair, from their edges ``(n, 4)``, each with its pair and its side, 0 or 1."""
    out = np.zeros(n_pairs)
    if not len(edges):
        return out
    # near the origin of each pair, so that large coordinates cancel first
    origin = np.full((n_pairs, 2), np.inf)
    np.minimum.at(origin, pair, np.minimum(edges[:, :2], edges[:, 2:]))
    edges = edges - np.tile(origin[pair], 2)
    edges, y0, y1, side, group, pair = _bands(edges, pair, side, n_pairs)
    if not len(edges):
        return out
    order = np.lexsort([side, group])
    edges, y0, y1, side, group, pair = (x[order] for x in (edges, y0, y1, side, group, pair))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    first = np.add.reduceat((side == 0).astype(np.int64), starts)  # edges of side 0 stand first in a group
    for a, b in _chunks(np.maximum(first * (sizes - first), sizes * (2 * sizes + 2))):
        s = slice(starts[a], starts[b - 1] + sizes[b - 1])
        areas = _group_areas(edges[s], y0[s], y1[s], side[s], starts[a:b] - starts[a], sizes[a:b], first[a:b])
        np.add.at(out, pair[starts[a:b]], areas)
    return out


def _crossings(edges: np.ndarray, y0: np.ndarray, y1: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heights at which two edges of a group cross inside both: ``(group, y)``; of one region's own edges too."""
    whole = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(whole)) - starts[whole]
    i, k = _repeated(sizes[whole] - place - 1)  # each edge with those after it
    j = i + 1 + k
    low, high = np.maximum(y0[i], y0[j]), np.minimum(y1[i], y1[j])
    met = low < high
    i, j, low, high = i[met], j[met], low[met], high[met]
    below, above = _x_at(edges[i], low) - _x_at(edges[j], low), _x_at(edges[i], high) - _x_at(edges[j], high)
    cross = below * above < 0
    below, above, low, high = below[cross], above[cross], low[cross], high[cross]
    return whole[i[cross]], low + (high - low) * (below / (below - above))


def _group_areas(edges: np.ndarray, y0: np.ndarray, y1: np.ndarray, side: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common area inside each group (a band of a pair)."""
    n = len(starts)
    whole = np.repeat(np.arange(n), sizes)
    met, at = _crossings(edges, y0, y1, starts, sizes, first, side)
    heights, owner = np.concatenate([y0, y1, at]), np.concatenate([whole, whole, met])
    order = np.lexsort([heights, owner])
    heights, owner = heights[order], owner[order]
    slab = np.flatnonzero((owner[1:] == owner[:-1]) & (heights[1:] > heights[:-1]))
    bottom, top, owner = heights[slab], heights[slab + 1], owner[slab]
    # each slab with the edges of its group that pass through it
    rows, k = _repeated(sizes[owner])
    edge = starts[owner[rows]] + k
    through = (y0[edge] <= bottom[rows]) & (y1[edge] >= top[rows])
    rows, edge = rows[through], edge[through]
    x = _x_at(edges[edge], (bottom[rows] + top[rows]) / 2)
    order = np.lexsort([x, rows])
    rows, edge, x = rows[order], edge[order], x[order]
    right = side[edge]
    # inside a region after an odd number of its edges; every slab has an even number, so sums need no restart
    inside = (np.cumsum(right == 0) % 2 == 1) & (np.cumsum(right == 1) % 2 == 1)
    both = np.flatnonzero(inside[:-1] & (rows[1:] == rows[:-1])) if len(rows) else np.empty(0, np.int64)
    areas = (x[both + 1] - x[both]) * (top - bottom)[rows[both]]
    return np.bincount(owner[rows[both]], areas, n)


def pair_areas(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> np.ndarray:
    """Common area of the regions ``a[i]`` and ``b[i]``, each a list of rings ``(n, 2)`` or flat."""
    parts, sides = [], []
    for k, regions in enumerate((a, b)):
        rings = [np.asarray(r, float).reshape(-1, 2) for region in regions for r in region]
        of_ring = np.repeat(np.arange(len(regions)), [len(region) for region in regions])
        edges, ring = ring_edges(np.concatenate([np.empty((0, 2)), *rings]), np.array([len(r) for r in rings], np.int64))
        parts.append((edges, of_ring[ring]))
        sides.append(np.full(len(edges), k))
    edges, pair = (np.concatenate(x) for x in zip(*parts, strict=True))
    return common_areas(edges, pair.astype(np.int64), np.concatenate(sides), len(a))


def _in_boxes(edges: np.ndarray, box: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, low end first, inside of the heights of their box ``(n, 4)``; what lies beside it is put onto its sides, so that parities hold."""
    some = edges[:, 1] != edges[:, 3]
    edges, box, owner = edges[some], box[some], owner[some]
    turned = edges[:, 1] > edges[:, 3]
    edges[turned] = edges[turned][:, [2, 3, 0, 1]]
    y0, y1 = np.maximum(edges[:, 1], box[:, 1]), np.minimum(edges[:, 3], box[:, 3])
    some = y0 < y1
    edges, box, owner, y0, y1 = edges[some], box[some], owner[some], y0[some], y1[some]
    edges = np.stack([_x_at(edges, y0), y0, _x_at(edges, y1), y1], axis=1)
    for side in (0, 2):
        bound = box[:, side]
        cut = np.flatnonzero((edges[:, 0] - bound) * (edges[:, 2] - bound) < 0)
        x0, y0, x1, y1 = edges[cut].T
        at = y0 + (y1 - y0) * ((bound[cut] - x0) / (x1 - x0))
        rest = np.stack([bound[cut], at, x1, y1], axis=1)
        edges[cut, 2], edges[cut, 3] = bound[cut], at
        edges, box, owner = np.concatenate([edges, rest]), np.concatenate([box, box[cut]]), np.concatenate([owner, owner[cut]])
    edges[:, ::2] = np.clip(edges[:, ::2], box[:, :1], box[:, 2:3])
    some = edges[:, 1] < edges[:, 3]
    return edges[some], owner[some]


def covered_areas(edges: np.ndarray, shape: np.ndarray, side: np.ndarray, group: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Areas ``(groups, 3)`` of the ground in a group's box that only shapes of side 0 cover, shapes of both sides, only those of side 1.

    ``edges (n, 4)`` of each ``shape``, read even-odd; shapes stand group by group, ``side`` and ``group`` are theirs. Groups are boxes ``(k, 4)``,
    cut into bands where they hold many edges, and these into slabs, as for ``common_areas``.
    """
    out = np.zeros((len(box), 3))
    edges = edges - np.tile(box[group[shape], :2], 2)
    edges, shape = _in_boxes(edges, (box - np.tile(box[:, :2], 2))[group[shape]], shape)
    order = np.argsort(shape, kind="stable")
    edges, shape = edges[order], shape[order]
    of_group = group[shape]
    # bands of large groups
    n_bands = np.maximum(1, np.bincount(of_group, minlength=len(box)) // GROUP_EDGES)
    height = (box[:, 3] - box[:, 1]) / n_bands
    first, last = (np.clip(np.floor(edges[:, k] / height[of_group]), 0, n_bands[of_group] - 1).astype(np.int64) for k in (1, 3))
    rows, copy = _repeated(last - first + 1)
    edges, shape, of_group, band = edges[rows], shape[rows], of_group[rows], first[rows] + copy
    y0 = np.where(band == 0, edges[:, 1], np.maximum(edges[:, 1], band * height[of_group]))
    y1 = np.where(band == n_bands[of_group] - 1, edges[:, 3], np.minimum(edges[:, 3], (band + 1) * height[of_group]))
    of_band = (np.cumsum(n_bands) - n_bands)[of_group] + band
    some = np.flatnonzero(y0 < y1)
    order = some[np.argsort(of_band[some], kind="stable")]
    edges, shape, y0, y1, of_band = (x[order] for x in (edges, shape, y0, y1, of_band))
    starts = np.flatnonzero(np.r_[True, of_band[1:] != of_band[:-1]][: len(of_band)])
    sizes = np.diff(np.r_[starts, len(of_band)])
    for a, b in _chunks(sizes * (sizes + 2)):
        s = slice(starts[a], starts[b - 1] + sizes[b - 1])
        areas = _band_coverage(edges[s], y0[s], y1[s], shape[s], side, starts[a:b] - starts[a], sizes[a:b])
        np.add.at(out, group[shape[starts[a:b]]], areas)
    return out


def _band_coverage(edges: np.ndarray, y0: np.ndarray, y1: np.ndarray, shape: np.ndarray, side: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``covered_areas`` inside each band."""
    whole = np.repeat(np.arange(len(starts)), sizes)
    # only slanted edges cross others
    slanted = np.flatnonzero(edges[:, 0] != edges[:, 2])
    i, k = _repeated(sizes[whole[slanted]])
    i, j = slanted[i], starts[whole[slanted]][i] + k
    some = (i < j) | (edges[j, 0] == edges[j, 2])
    i, j = i[some], j[some]
    low, high = np.maximum(y0[i], y0[j]), np.minimum(y1[i], y1[j])
    met = low < high
    i, j, low, high = i[met], j[met], low[met], high[met]
    below, above = _x_at(edges[i], low) - _x_at(edges[j], low), _x_at(edges[i], high) - _x_at(edges[j], high)
    cross = below * above < 0
    at = low[cross] + (high - low)[cross] * (below[cross] / (below - above)[cross])
    heights, owner = np.concatenate([y0, y1, at]), np.concatenate([whole, whole, whole[i[cross]]])
    order = np.lexsort([heights, owner])
    new = np.r_[True, (heights[order][1:] != heights[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    heights, owner = heights[order][new], owner[order][new]
    # each edge in the slabs that it passes through
    n = len(edges)
    rows, k = _repeated(place[n : 2 * n] - place[:n])
    slab = place[:n][rows] + k
    x = _x_at(edges[rows], (heights[slab] + heights[slab + 1]) / 2)
    order = np.lexsort([x, slab * (int(shape.max()) + 1) + shape[rows]])
    slab, x, right = slab[order], x[order], side[shape[rows[order]]]
    # of each shape in a slab edges go in and out in turn, and every shape has an even number of them there
    way = np.where(np.arange(len(x)) % 2 == 0, 1, -1)
    order = np.lexsort([x, slab])
    slab, x, right, way = slab[order], x[order], right[order], way[order]
    left, right = (np.cumsum(np.where(right == k, way, 0)) > 0 for k in (0, 1))
    at = np.flatnonzero((left | right)[:-1] & (slab[1:] == slab[:-1]))
    kind = np.where(left[at], np.where(right[at], 1, 0), 2)
    areas = (x[at + 1] - x[at]) * (heights[slab[at] + 1] - heights[slab[at]])
    return np.bincount(owner[slab[at]] * 3 + kind, areas, 3 * len(starts)).reshape(-1, 3)


def corner_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of right-angled polygons ``a[i] (k, n, 2)`` and ``b[i] (k, m, 2)``; NaN where one isn't right-angled and plain.

    Such a polygon is a sum of quadrants above and to the right of its corners, with signs in turn, and two quadrants
    share one from the higher of their corners on. By the same sum a polygon meets itself in its own area only if none of its
    ground is wound about twice; others, and those with corners on a side, are left to the slabs. Whole numbers are exact.
    """
    low = np.minimum(a.min(axis=1), b.min(axis=1))[:, None]
    a, b = a - low, b - low
    top = np.maximum(a.max(axis=1), b.max(axis=1))
    plain = np.ones(len(a), bool)
    signs = []
    for p in (a, b):
        step = np.roll(p, -1, axis=1) - p
        level, upright = (step[..., 1] == 0) & (step[..., 0] != 0), (step[..., 0] == 0) & (step[..., 1] != 0)
        in_turn = np.arange(p.shape[1]) % 2 == 0
        plain &= ((level == in_turn) & (upright == ~in_turn)).all(axis=1) | ((level == ~in_turn) & (upright == in_turn)).all(axis=1)
        signs.append(np.where(in_turn, 1.0, -1.0))

    def shared(p: np.ndarray, q: np.ndarray, ps: np.ndarray, qs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p))
        for i in range(p.shape[1]):
            for j in range(q.shape[1]):
                out += ps[i] * qs[j] * (top[:, 0] - np.maximum(p[:, i, 0], q[:, j, 0])) * (top[:, 1] - np.maximum(p[:, i, 1], q[:, j, 1]))
        return out

    turn = np.ones(len(a))
    for p, s in zip((a, b), signs, strict=True):
        own = ((top[:, None] - p).prod(axis=2) * s).sum(axis=1)
        plain &= shared(p, p, s, s) == np.abs(own)
        turn *= np.sign(own)
    return np.where(plain, turn * shared(a, b, *signs), np.nan)
