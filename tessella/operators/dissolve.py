"""Union of any number of polygons, cell by cell: clip, unite inside a cell, cancel and stitch at the cells' borders.

Edges get a corner wherever they cross a line of the grid, by the same arithmetic for every cell, so that what
two cells have on their common border ends at equal points. Inside a cell shapes are united ``FAN`` at a time, level
by level, so a crowded cell is no unbounded group. Edges of neighbouring cells along their border run against each
other and cancel where both are filled; the rest is put together to chains inside cells, and chains to rings by
equal end points. A region is an array of flat rings, read even-odd; the rings that come out are exteriors
(counter-clockwise, area positive) and holes (clockwise, area negative).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import polygon as P
from tessella.functions.kernels import clip_ring, clip_rings, ring_area
from tessella.functions.overlay import Rings, combined_many
from tessella.functions.slabs import _chunks, _repeated, covered_areas, ring_edges
from tessella.operators.components import connected_components
from tessella.session import spread, written

FAN = 16  # shapes united at once
MOST_CORNERS = 2_048  # of shapes in a cell that are measured without their union
PARTS = ("only_left", "common", "only_right")
BATCH_ROWS = 4_096  # rows of small groups that one call of Python takes
GRAINS = 2.0**30  # of a cell's side: the distance of the points that corners may take


def with_grid_corners(rings: Rings, cell: float) -> Rings:
    """Rings with a corner wherever an edge crosses a line of the grid; all corners are multiples of ``cell / GRAINS``."""
    own = [p for r in rings if len(p := np.asarray(r, float).reshape(-1, 2)) > 2]
    if not own:
        return []
    points, sizes = _grid_corners(np.concatenate(own), np.array([len(r) for r in own], np.int64), cell)
    return np.split(points, np.cumsum(sizes)[:-1])


def _grid_corners(points: np.ndarray, sizes: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """``with_grid_corners`` for rings of ``sizes`` corners that follow one another in ``points (n, 2)``."""
    grain = cell / GRAINS
    edges, ring = ring_edges(np.rint(points / grain) * grain, sizes)
    turned = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    way = np.where(turned[:, None], edges[:, [2, 3, 0, 1]], edges)  # one direction for the arithmetic, whoever's edge it is
    points, at, order = [edges[:, :2]], [np.arange(len(edges))], [np.full(len(edges), -1.0)]
    for axis in (0, 1):
        low, high = np.minimum(way[:, axis], way[:, axis + 2]), np.maximum(way[:, axis], way[:, axis + 2])
        first, last = np.floor(low / cell).astype(np.int64) + 1, np.ceil(high / cell).astype(np.int64) - 1
        n = np.maximum(last - first + 1, 0)
        e = np.repeat(np.arange(len(edges)), n)
        line = (first[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)) * cell
        share = (line - way[e, axis]) / (way[e, axis + 2] - way[e, axis])
        other = way[e, 1 - axis] + share * (way[e, 3 - axis] - way[e, 1 - axis])
        other = np.rint(other / grain) * grain
        points.append(np.stack([line, other] if axis == 0 else [other, line], axis=1))
        at.append(e)
        order.append(np.where(turned[e], 1 - share, share))
    points, at, order = (np.concatenate(x) for x in (points, at, order))
    place = np.lexsort([order, at])
    return points[place], np.bincount(ring[at], minlength=len(sizes))


def _flat(rings: Rings) -> list[list[float]]:
    return [r.ravel().tolist() for r in rings]


def _cell_part(rings: Rings, cx: int, cy: int, cell: float) -> Rings:
    """What of rings with corners on the grid lies in a cell; empty if that has no area."""
    b = np.array([cx, cy, cx + 1, cy + 1]) * cell
    part = [c for c in (clip_ring(r, b) for r in rings) if len(c) > 2]
    return part if any(ring_area(r) for r in part) else []


def _clipped_batches(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """``(key, cx, cy, rings)``: each region's part in each cell that its box touches; many parts at once."""
    for batch in batches:
        regions = batch.column("rings")
        flat = regions.flatten()
        of = np.repeat(np.arange(len(regions)), regions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        xy = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
        some = sizes > 2
        points, sizes, of = xy[np.repeat(some, sizes)], sizes[some], of[some]
        if not len(sizes):
            continue
        points, sizes = _grid_corners(points, sizes, cell)
        # rings of a region follow one another: its box, its cells, its rings
        region, first, n_rings = np.unique(of, return_index=True, return_counts=True)
        starts = np.cumsum(sizes) - sizes
        low, high = (np.floor(np.minimum.reduceat(points, starts[first]) / cell).astype(np.int64), np.ceil(np.maximum.reduceat(points, starts[first]) / cell).astype(np.int64))
        n = np.maximum(high, low + 1) - low
        row, k = _repeated(n.prod(axis=1))
        cx, cy = low[row, 0] + k // n[row, 1], low[row, 1] + k % n[row, 1]
        for a, b in _chunks(4 * np.add.reduceat(sizes, first)[row]):
            at, k = _repeated(n_rings[row[a:b]])
            ring = first[row[a:b]][at] + k
            p, k = _repeated(sizes[ring])
            boxes = np.stack([cx[a:b], cy[a:b], cx[a:b] + 1, cy[a:b] + 1], axis=1)[at] * cell
            clipped, c_sizes = clip_rings(points[starts[ring][p] + k], sizes[ring], boxes)
            clipped, at, c_sizes = clipped[np.repeat(c_sizes > 2, c_sizes)], at[c_sizes > 2], c_sizes[c_sizes > 2]
            edges, of_edge = ring_edges(clipped, c_sizes)
            x0, y0, x1, y1 = (edges - np.tile(clipped[(np.cumsum(c_sizes) - c_sizes)[of_edge]], 2)).T
            full = np.bincount(at[np.bincount(of_edge, x0 * y1 - x1 * y0, len(c_sizes)) != 0], minlength=b - a) > 0
            kept, rows = full[at], np.flatnonzero(full)
            clipped, at, c_sizes = clipped[np.repeat(kept, c_sizes)], at[kept], c_sizes[kept]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * c_sizes)].astype(np.int32)), pa.array(clipped.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=b - a)[full])].astype(np.int32)), lists)
            keys = batch.column("key").take(pa.array(region[row[a:b][rows]]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(cx[a:b][rows]), pa.array(cy[a:b][rows]), lists], ["key", "cx", "cy", "rings"])


def _in_batches(rows: DataFrame, keys: list[str], n_rows: int, step: Callable, kinds: dict[str, pa.DataType], schema: str, at_once: bool = False) -> DataFrame:
    """``step(key values, {column: values}) -> rows`` for each group of ``rows`` by ``keys``, many small groups to a call of Python.

    ``at_once``: ``step`` takes all groups of a batch, as pairs of key values and columns. A batch is a hash bucket of about
    BATCH_ROWS rows. ``kinds``: the columns that ``step`` gives after ``key``.
    """

    def each(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        groups: dict[tuple, list[int]] = {}
        for i, group in enumerate(zip(*(columns[k] for k in keys), strict=True)):
            groups.setdefault(group, []).append(i)
        own = [(group, {c: [v[i] for i in at] for c, v in columns.items()}) for group, at in groups.items()]
        out = list(step(own)) if at_once else [row for group in own for row in step(*group)]
        found = list(zip(*out, strict=True)) or [()] * (len(kinds) + 1)
        arrays = [pa.array(v, k) for v, k in zip(found, (table.schema.field("key").type, *kinds.values()), strict=True)]
        return pa.Table.from_arrays(arrays, ["key", *kinds])

    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n_rows // BATCH_ROWS))))
    return rows.groupBy(bucket).applyInArrow(each, schema)


_RINGS = pa.list_(pa.list_(pa.float64()))
_CELL = {"cx": pa.int64(), "cy": pa.int64()}
_ENDS = dict.fromkeys(("x0", "y0", "x1", "y1"), pa.float64())


def _arrays(region: list[list[float]]) -> Rings:
    return [np.asarray(r, float).reshape(-1, 2) for r in region]


def _side(cell: float) -> float:
    """The power of two from ``cell`` upwards: lines and corners are then exact, those of whole numbers too."""
    return 2.0 ** math.ceil(math.log2(cell))


def union_cells(shapes: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``(key, cx, cy, rings)``: the union of the regions of each key, in each cell of the grid that it touches.

    ``cell`` is rounded up to a power of two. Cells about as large as a few shapes keep the work small.
    """
    cell = _side(cell)
    kind = shapes.schema[key].dataType.simpleString()
    schema = f"key {kind}, cx long, cy long, rings array<array<double>>"
    own = shapes.select(F.col(key).alias("key"), F.col(rings).cast("array<array<double>>").alias("rings"))
    return _united(written(spread(own).mapInArrow(lambda batches: _clipped_batches(batches, cell), schema), "clipped"), cell)


def _united(parts: DataFrame, cell: float) -> DataFrame:
    """The union of all ``parts(key, cx, cy, rings)`` of a cell, FAN at a time."""
    kind = parts.schema["key"].dataType.simpleString()
    parts = parts.distinct()
    cells = parts.groupBy("key", "cx", "cy").count().select(F.col("key").alias("k"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.ceil(F.col("count") / FAN).alias("groups"))
    here = F.col("key").eqNullSafe(F.col("k")) & (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y"))
    leaf = F.pmod(F.xxhash64("rings"), F.col("groups"))
    parts = written(parts.join(cells, here).select("key", "cx", "cy", leaf.alias("leaf"), "rings"), "cell_parts")
    most, n = parts.agg(F.max("leaf"), F.count(F.lit(1))).first()

    def unite(groups: list[tuple[tuple, dict]]) -> Iterator[tuple]:
        alone = [len(c["rings"]) == 1 and len(c["rings"][0]) == 1 for _, c in groups]
        found = combined_many([[] if one else [_arrays(r) for r in c["rings"]] for (_, c), one in zip(groups, alone, strict=True)], np.logical_or, cell / GRAINS)
        for (group, columns), one, rings in zip(groups, alone, found, strict=True):
            yield *group, columns["rings"][0] if one else _flat(rings)

    while most is not None:
        parts = _in_batches(parts, ["key", "cx", "cy", "leaf"], n, unite, {**_CELL, "leaf": pa.int64(), "rings": _RINGS}, f"key {kind}, cx long, cy long, leaf long, rings array<array<double>>", at_once=True)
        if not most:
            break
        parts, most = parts.withColumn("leaf", F.floor(F.col("leaf") / FAN)), most // FAN
    return parts.select("key", "cx", "cy", "rings")


def union_area(shapes: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``(key, area)`` of the union of the regions of each key."""
    return set_areas(shapes, shapes.limit(0), key, rings, cell).select(key, F.col("only_left").alias("area"))


def _cell_copies(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """``(key, side, rings)`` with a row, and the number of its corners, for each cell that the region's box touches; not clipped."""
    for batch in batches:
        regions = batch.column("rings")
        sizes, xy = _corners(regions)
        of = np.repeat(np.arange(len(regions)), sizes)
        low, high = np.full((len(regions), 2), np.inf), np.full((len(regions), 2), -np.inf)
        np.minimum.at(low, of, xy)
        np.maximum.at(high, of, xy)
        some = np.flatnonzero((sizes > 2) & (low < high).all(axis=1))
        first, last = np.floor(low[some] / cell).astype(np.int64), np.ceil(high[some] / cell).astype(np.int64)
        n = last - first
        rows, k = _repeated(n.prod(axis=1))
        at = some[rows]
        columns = {"key": batch.column("key").take(pa.array(at)), "side": batch.column("side").take(pa.array(at)), "cx": first[rows, 0] + k // n[rows, 1], "cy": first[rows, 1] + k % n[rows, 1], "corners": sizes[at], "rings": regions.take(pa.array(at))}
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def _corners(regions: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of corners of each region of a batch, and all corners."""
    flat = regions.flatten()
    counts = regions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    of = np.repeat(np.arange(len(regions)), counts)
    return np.bincount(of, sizes, len(regions)).astype(np.int64), flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)


def _cell_areas(rows: pa.Table, cell: float) -> pa.Table:
    """``(key, only_left, common, only_right)``: the ground of whole cells by the sides that cover it, summed for each key."""
    rows = rows.combine_chunks()
    keys = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode")
    where = np.stack([keys.indices.to_numpy(zero_copy_only=False), rows["cx"].to_numpy(), rows["cy"].to_numpy()], axis=1).astype(np.int64)
    order = np.lexsort(where.T)
    rows, where = rows.take(pa.array(order)), where[order]
    new = np.r_[True, (where[1:] != where[:-1]).any(axis=1)]
    regions = rows["rings"].combine_chunks()
    flat = regions.flatten()
    _, xy = _corners(regions)
    edges, ring = ring_edges(xy, flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2)
    shape = np.repeat(np.arange(len(regions)), regions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[ring]
    low = where[new, 1:] * cell
    areas = covered_areas(edges, shape, rows["side"].to_numpy(), np.cumsum(new) - 1, np.concatenate([low, low + cell], axis=1))
    codes, of = np.unique(where[new, 0], return_inverse=True)
    sums = [pa.array(np.bincount(of, a, len(codes))) for a in areas.T]
    return pa.Table.from_arrays([keys.dictionary.take(pa.array(codes)), *sums], ["key", *PARTS])


def set_areas(left: DataFrame, right: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``(key, only_left, common, only_right)``: areas of the ground that left regions cover, right ones, and both; keys without any have no row.

    Shapes of a cell are measured as they are, without their unions; only those of cells with more than MOST_CORNERS corners are united first.
    """
    cell, kind = _side(cell), left.schema[key].dataType.simpleString()
    sides = [x.select(F.col(key).alias("key"), F.lit(k).cast("long").alias("side"), F.col(rings).cast("array<array<double>>").alias("rings")) for k, x in enumerate((left, right))]
    where, region = f"key {kind}, side long, cx long, cy long", "rings array<array<double>>"
    parts = written(spread(sides[0].unionByName(sides[1])).mapInArrow(lambda batches: _cell_copies(batches, cell), f"{where}, corners long, {region}"), "cells")
    counts = parts.groupBy("key", "cx", "cy").agg(F.sum("corners").alias("corners"), F.count(F.lit(1)).alias("n"))
    crowded = written(counts.where((F.col("corners") > MOST_CORNERS) & (F.col("n") > 2)).select(F.col("key").alias("k"), F.col("cx").alias("x"), F.col("cy").alias("y")), "crowded")
    rows = parts.drop("corners")
    if not crowded.isEmpty():
        here = F.col("key").eqNullSafe(F.col("k")) & (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y"))

        def clipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = [_flat(_cell_part(with_grid_corners(r, cell), x, y, cell)) for r, x, y in zip(f.rings, f.cx, f.cy, strict=True)]
                some = [len(r) > 0 for r in found]
                yield pd.DataFrame({"key": f.key, "cx": 2 * f.cx + f.side, "cy": f.cy, "rings": pd.Series(found, index=f.index, dtype=object)})[some]

        # the side of a part goes with its cell's number
        united = _united(written(rows.join(crowded, here, "left_semi").mapInPandas(clipped, f"key {kind}, cx long, cy long, {region}"), "clipped"), cell)
        united = united.select("key", F.pmod("cx", F.lit(2)).alias("side"), F.floor(F.col("cx") / 2).alias("cx"), "cy", "rings")
        rows = rows.join(crowded, here, "left_anti").unionByName(united)
    bucket = F.pmod(F.xxhash64("key", "cx", "cy"), F.lit(max(1, -(-parts.count() // BATCH_ROWS))))
    areas = rows.groupBy(bucket).applyInArrow(lambda t: _cell_areas(t, cell), f"key {kind}, {', '.join(f'{p} double' for p in PARTS)}")
    return areas.groupBy(F.col("key").alias(key)).agg(*[F.sum(p).alias(p) for p in PARTS]).where(" + ".join(PARTS) + " > 0")


def _cell_edges(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """Directed edges of each cell's union. ``axis`` and ``line`` name the border that an edge lies on; axis 2: none."""
    for batch in batches:
        regions = batch.column("rings")
        flat = regions.flatten()
        of = np.repeat(np.arange(len(regions)), regions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        edges, ring = ring_edges(flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2), sizes)
        row = of[ring]
        cx, cy = (batch.column(c).to_numpy()[row] for c in _CELL)
        axis, line = np.full(len(edges), 2, np.int32), np.zeros(len(edges), np.int64)
        for a, c in ((0, cx), (1, cy)):
            for k in (c, c + 1):
                on = (edges[:, a] == k * cell) & (edges[:, a + 2] == k * cell)
                axis[on], line[on] = a, k[on]
        columns = {"key": batch.column("key").take(pa.array(row)), "cx": cx, "cy": cy, "axis": axis, "line": line, **dict(zip(_ENDS, edges.T, strict=True))}
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def _left_over(group: tuple, columns: dict) -> Iterator[tuple]:
    """What edges along a piece of one border line leave when those that run against each other cancel."""
    key, axis = group[:2]
    a, b = (np.array(columns[c]) for c in (("y0", "y1") if axis == 0 else ("x0", "x1")))
    fixed = columns["x0" if axis == 0 else "y0"][0]
    places = np.unique(np.concatenate([a, b]))
    net = np.zeros(len(places))
    np.add.at(net, np.searchsorted(places, np.minimum(a, b)), np.sign(b - a))
    np.add.at(net, np.searchsorted(places, np.maximum(a, b)), -np.sign(b - a))
    net = np.cumsum(net)[:-1]
    for i in np.flatnonzero(net).tolist():
        start, end = (places[i], places[i + 1]) if net[i] > 0 else (places[i + 1], places[i])
        ends = (fixed, start, fixed, end) if axis == 0 else (start, fixed, end, fixed)
        yield key, columns["cx"][0], columns["cy"][0], *map(float, ends)


def _chains(edges: np.ndarray) -> list[np.ndarray]:
    """Directed edges ``(n, 4)`` put together as far as they go; where several go on, the sharpest right turn."""
    ways: dict[tuple, list[tuple]] = defaultdict(list)
    entries: dict[tuple, int] = defaultdict(int)
    for x0, y0, x1, y1 in edges.tolist():
        ways[x0, y0].append((x1, y1))
        entries[x1, y1] += 1
    out = []

    def follow(at: tuple) -> None:
        chain, last = [at], None
        while options := ways.get(at):
            to = options[0]
            if len(options) > 1 and last is not None:
                back = np.arctan2(last[1] - at[1], last[0] - at[0])
                to = max(options, key=lambda o: (np.arctan2(o[1] - at[1], o[0] - at[0]) - back) % (2 * np.pi))
            options.remove(to)
            chain.append(to)
            last, at = at, to
            if at == chain[0]:
                break
        out.append(np.array(chain))

    for start in sorted(ways):
        for _ in range(len(ways[start]) - entries[start]):
            follow(start)
    for start in sorted(ways):
        while ways[start]:
            follow(start)
    return out


def _straightened(ring: np.ndarray) -> np.ndarray:
    """A ring (without its closing point) without corners that lie on the way from the one before to the next."""
    while len(ring) > 2:
        before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        bent = (before[:, 0] * after[:, 1] != before[:, 1] * after[:, 0]) | ((before * after).sum(axis=1) < 0)
        if bent.all():
            return ring
        ring = ring[bent]
    return ring


def _chained(group: tuple, columns: dict) -> Iterator[tuple]:
    for chain in _chains(np.array([columns[c] for c in _ENDS]).T):
        yield group[0], chain.ravel().tolist()


def _stitched(group: tuple, columns: dict) -> Iterator[tuple]:
    points = [np.asarray(c, float).reshape(-1, 2) for c in columns["chain"]]
    for ring in _chains(np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) for p in points])):
        yield group[0], ring.ravel().tolist()


def _measured(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rings = [_straightened(np.asarray(c, float).reshape(-1, 2)[:-1]) for c in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([r.ravel().tolist() for r in rings], pa.list_(pa.float64())), pa.array([ring_area(r) for r in rings], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, [key, "ring", "area"])


#: What stays of two regions, by membership in the first and in the second.
OPERATIONS = {
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a ^ b,
    "union": lambda a, b: a | b,
}


def set_cells(left: DataFrame, right: DataFrame, key: str, rings: str, operation: str, cell: float) -> DataFrame:
    """``(key, cx, cy, rings)``: for each key the union of the left regions and that of the right ones, put together by OPERATIONS.

    A key that stands on one side only meets an empty region. Both unions are made by cells; equal cells are joined.
    """
    cell, keep = _side(cell), OPERATIONS[operation]
    kind = left.schema[key].dataType.simpleString()
    one, two = union_cells(left, key, rings, cell), union_cells(right, key, rings, cell).withColumnsRenamed({"key": "k", "cx": "x", "cy": "y", "rings": "others"})
    here = F.col("key").eqNullSafe(F.col("k")) & (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y"))
    how = {"intersection": "inner", "difference": "left"}.get(operation, "full")
    joined = one.join(two, here, how).select(F.when(F.col("cx").isNotNull(), F.col("key")).otherwise(F.col("k")).alias("key"), F.coalesce("cx", "x").alias("cx"), F.coalesce("cy", "y").alias("cy"), "rings", "others")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            regions = [_flat(r) for r in combined_many([[_arrays(a or []), _arrays(b or [])] for a, b in pairs], keep, cell / GRAINS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(regions, _RINGS)], ["key", "cx", "cy", "rings"])

    return joined.mapInArrow(put_together, f"key {kind}, cx long, cy long, rings array<array<double>>").where(F.size("rings") > 0)


def set_area(left: DataFrame, right: DataFrame, key: str, rings: str, operation: str, cell: float) -> DataFrame:
    """``(key, area)`` of a set operation; keys of which nothing is left have no row."""
    kept = [p for p, (a, b) in zip(PARTS, ((True, False), (True, True), (False, True)), strict=True) if OPERATIONS[operation](np.array([a]), np.array([b]))[0]]
    area = sum((F.col(p) for p in kept), F.lit(0.0))
    return set_areas(left, right, key, rings, cell).select(key, area.alias("area")).where("area > 0")


def set_rings(left: DataFrame, right: DataFrame, key: str, rings: str, operation: str, cell: float) -> DataFrame:
    """As ``union_rings`` for a set operation."""
    return _bounding_rings(set_cells(left, right, key, rings, operation, cell), key, _side(cell))


def union_rings(shapes: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``(key, ring, area)``: the flat rings that bound the union of the regions of each key; holes have a negative area.

    Corners are rounded to a billionth of a cell. A null region, or one without area, adds nothing. Rings that touch
    in a point may come as one ring or as two. A ring over many cells is put together in one group: it is one row.
    """
    return _bounding_rings(union_cells(shapes, key, rings, cell), key, _side(cell))


def _bounding_rings(cells: DataFrame, key: str, cell: float) -> DataFrame:
    """``(key, ring, area)`` of regions cut into cells."""
    kind = cells.schema["key"].dataType.simpleString()
    where = f"key {kind}, cx long, cy long"
    ends = "x0 double, y0 double, x1 double, y1 double"
    chain = {"chain": pa.list_(pa.float64())}
    edges = written(cells.mapInArrow(lambda batches: _cell_edges(batches, cell), f"{where}, axis int, line long, {ends}"), "cell_edges")
    n_edges = edges.count()
    inner = edges.where("axis = 2").select("key", "cx", "cy", *_ENDS)
    along = F.when(F.col("axis") == 0, F.col("cy")).otherwise(F.col("cx"))
    border = _in_batches(edges.where("axis < 2").withColumn("along", along), ["key", "axis", "line", "along"], n_edges, _left_over, {**_CELL, **_ENDS}, f"{where}, {ends}")
    chains = written(_in_batches(inner.unionByName(border), ["key", "cx", "cy"], n_edges, _chained, chain, f"key {kind}, chain array<double>"), "chains")
    n = F.size("chain")
    point = lambda i, j: F.xxhash64("key", F.get("chain", i) + 0.0, F.get("chain", j) + 0.0)
    placed = chains.withColumn("first", point(F.lit(0), F.lit(1))).withColumn("last", point(n - 2, n - 1))
    closed = placed.where("first = last").select("key", "chain")
    open_ = written(placed.where("first <> last"), "open_chains")
    groups = connected_components(open_.select(F.col("first").alias("a"), F.col("last").alias("b")))
    joined = _in_batches(open_.join(groups, F.col("first") == F.col("node")).select("key", "component", "chain"), ["key", "component"], open_.count(), _stitched, chain, f"key {kind}, chain array<double>")
    return closed.unionByName(joined).mapInArrow(partial(_measured, key=key), f"`{key}` {kind}, ring array<double>, area double").where("area <> 0")
