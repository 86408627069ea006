"""Many boxes or polygons of a batch as flat arrays, and the pairs of one group that meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.functions.slabs import _chunks, _repeated, pair_areas, ring_edges

MOST_BOXES = 8  # that a right-angled polygon is taken apart into


class Boxes:
    """Boxes by their ends ``low`` and ``high (n, 2)``; whole numbers stay whole."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high
        self.area = (high - low).prod(axis=1)

    def most(self, i: np.ndarray, other: Boxes, j: np.ndarray) -> np.ndarray:
        """Common areas of the boxes ``i`` with the other's ``j``."""
        return np.maximum(np.minimum(self.high[i], other.high[j]) - np.maximum(self.low[i], other.low[j]), 0).prod(axis=1)

    def common(self, i: np.ndarray, other: Boxes, j: np.ndarray) -> np.ndarray:
        return self.most(i, other, j)


class Polygons(Boxes):
    """Polygons from flat coordinates, read even-odd; nulls are empty. ``low`` and ``high`` are their bounds.

    Right-angled ones are taken apart into disjoint boxes once, so that pairs of them are sums over boxes; others go by slabs.
    """

    def __init__(self, flat: pa.Array):
        n = len(flat)
        sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        xy = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
        first = np.cumsum(sizes) - sizes
        some = sizes > 0
        self.low, self.high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        if some.any():
            self.low[some], self.high[some] = np.minimum.reduceat(xy, first[some]), np.maximum.reduceat(xy, first[some])
        edges, of = ring_edges(xy, sizes)
        x0, y0, x1, y1 = (edges - np.tile(xy[first[of]], 2)).T
        self.area = np.abs(np.bincount(of, x0 * y1 - x1 * y0, n)) / 2
        self.rings = (xy, first, sizes)
        self._take_apart(edges, of, n)

    def _take_apart(self, edges: np.ndarray, of: np.ndarray, n: int) -> None:
        slanted = ~((edges[:, 0] == edges[:, 2]) | (edges[:, 1] == edges[:, 3]))
        self.in_boxes = np.bincount(of[slanted], minlength=n) == 0
        up = (edges[:, 0] == edges[:, 2]) & (edges[:, 1] != edges[:, 3]) & self.in_boxes[of]
        x, of = edges[up, 0], of[up]
        y = np.sort(edges[up][:, [1, 3]], axis=1).T
        heights, owner = y.ravel(), np.tile(of, 2)
        order = np.lexsort([heights, owner])
        new = np.r_[True, (heights[order][1:] != heights[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        heights = heights[order][new]
        rows, k = _repeated(place[len(of) :] - place[: len(of)])
        slab = place[: len(of)][rows] + k
        order = np.lexsort([x[rows], slab])
        slab, x, of = slab[order], x[rows][order], of[rows][order]
        boxes = np.stack([x[::2], heights[slab[::2]], x[1::2], heights[slab[::2] + 1]], axis=1)
        of, boxes = of[::2][x[::2] < x[1::2]], boxes[x[::2] < x[1::2]]
        n_boxes = np.bincount(of, minlength=n)
        self.in_boxes &= n_boxes <= MOST_BOXES
        boxes, of = boxes[self.in_boxes[of]], of[self.in_boxes[of]]
        order = np.argsort(of, kind="stable")
        of, boxes = of[order], boxes[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        none = np.array([np.inf, np.inf, -np.inf, -np.inf])
        self.parts = np.tile(none, (int(nth.max()) + 1 if len(of) else 1, n, 1))
        self.parts[nth, of] = boxes

    def common(self, i: np.ndarray, other: Polygons, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        boxed = self.in_boxes[i] & other.in_boxes[j]
        at = slice(None) if boxed.all() else np.flatnonzero(boxed)
        for p in self.parts:
            a = p[i[at]]
            for q in other.parts:
                b = q[j[at]]
                x, y = (np.minimum(a[:, k + 2], b[:, k + 2]) - np.maximum(a[:, k], b[:, k]) for k in (0, 1))
                out[at] += np.where((x > 0) & (y > 0), x * y, 0.0)
        if not boxed.all():
            rest = np.flatnonzero(~boxed)
            out[rest] = pair_areas([[self.ring(k)] for k in i[rest]], [[other.ring(k)] for k in j[rest]])
        return out

    def ring(self, k: int) -> np.ndarray:
        xy, first, sizes = self.rings
        return xy[first[k] : first[k] + sizes[k]]


def meeting(one: Boxes, starts: np.ndarray, sizes: np.ndarray, two: Boxes | None = None, two_starts: np.ndarray | None = None, two_sizes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i, j`` of rows of one group, from ``starts`` on, whose boxes share ground: ``i < j`` of one table, or of two tables with equal groups."""
    n_rows, n_others = sizes, sizes if two is None else two_sizes
    for a, b in _chunks(n_rows * n_others * 8):
        group, k = _repeated(n_rows[a:b])
        group += a
        i = starts[group] + k
        if two is None:
            left = starts[group] + sizes[group] - i - 1
            rows, k = _repeated(left)
            i, j, other = i[rows], i[rows] + 1 + k, one
        else:
            rows, k = _repeated(two_sizes[group])
            i, j, other = i[rows], two_starts[group[rows]] + k, two
        for axis in (0, 1):
            near = (one.low[i, axis] < other.high[j, axis]) & (other.low[j, axis] < one.high[i, axis])
            i, j = i[near], j[near]
        yield i, j
