import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import slabs
from tessella.functions.kernels import ring_area
from tessella.functions.overlay import _edges, combined, inside
from tessella.operators import dissolve

SCHEMA = "k string, rings array<array<double>>"


def ell(x, y, w, h):
    return [float(v) for v in (x, y, x + w, y, x + w, y + h // 2, x + w // 2, y + h // 2, x + w // 2, y + h, x, y + h)]


def pixels(x, y, w, h):
    return {(x + a, y + b) for a in range(w) for b in range(h) if not (a >= w // 2 and b >= h // 2)}


def border(found):
    return sum((x + dx, y + dy) not in found for x, y in found for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@pytest.mark.parametrize("cell", [16.0, 1000.0])
def test_union_of_many_overlapping_shapes_equals_pixels(spark, cell, monkeypatch):
    monkeypatch.setattr(dissolve, "FAN", 4)  # several levels
    r = random.Random(1)
    shapes = [(r.choice("ab"), r.randrange(-30, 60), r.randrange(-30, 60), r.randrange(2, 25), r.randrange(2, 25)) for _ in range(150)]
    found = {k: set().union(*(pixels(*s[1:]) for s in shapes if s[0] == k)) for k in "ab"}
    df = spark.createDataFrame([(s[0], [ell(*s[1:])]) for s in shapes] + [("a", None), ("b", []), ("a", [[0.0, 0.0, 5.0, 5.0]])], SCHEMA).repartition(3)
    assert dict(dissolve.union_area(df, "k", "rings", cell).collect()) == {k: len(v) for k, v in found.items()}
    rows = dissolve.union_rings(df, "k", "rings", cell).collect()
    for k in "ab":
        rings = [np.array(x.ring).reshape(-1, 2) for x in rows if x.k == k]
        assert sum(ring_area(p) for p in rings) == len(found[k]) == sum(x.area for x in rows if x.k == k)
        assert sum(np.abs(p - np.roll(p, -1, axis=0)).sum() for p in rings) == border(found[k])
        middles = np.array([(x + 0.5, y + 0.5) for x in range(-35, 90) for y in range(-35, 90)])
        assert {(int(x - 0.5), int(y - 0.5)) for x, y in middles[inside(middles, np.concatenate([_edges([p]) for p in rings]))]} == found[k]


def test_general_polygons_and_holes(spark):
    r = np.random.default_rng(5)
    shapes = []
    for _ in range(40):
        t = np.sort(r.random(9)) * 2 * np.pi
        q = 8 * (0.3 + 0.7 * r.random(9))
        shapes.append(np.stack([r.uniform(0, 40) + q * np.cos(t), r.uniform(0, 40) + q * np.sin(t)], axis=1))
    frame_ = np.array([[-20, -20], [60, -20], [60, 60], [-20, 60]], float)
    hole = np.array([[-15, -15], [55, -15], [55, 55], [-15, 55]], float)
    df = spark.createDataFrame([("s", [p.ravel().tolist()]) for p in shapes] + [("s", [frame_.ravel().tolist(), hole.ravel().tolist()])], SCHEMA)
    rows = dissolve.union_rings(df, "k", "rings", 7.3).collect()
    rings = [np.array(x.ring).reshape(-1, 2) for x in rows]
    at = r.uniform(-25, 65, (20_000, 2))
    want = np.logical_or.reduce([inside(at, _edges([p])) for p in shapes]) | (inside(at, _edges([frame_])) & ~inside(at, _edges([hole])))
    assert (inside(at, np.concatenate([_edges([p]) for p in rings])) == want).mean() > 0.9999
    area = dict(dissolve.union_area(df, "k", "rings", 7.3).collect())["s"]
    assert area == pytest.approx(sum(ring_area(p) for p in rings), rel=1e-7)
    assert min(x.area for x in rows) < 0  # the ground between frame and shapes is a hole


def test_a_shape_over_many_cells_is_one_ring(spark):
    df = spark.createDataFrame([("a", [[0.5, 0.5, 9.5, 0.5, 9.5, 9.5, 0.5, 9.5]]), ("a", [[0.5, 0.5, 9.5, 0.5, 9.5, 9.5, 0.5, 9.5]])], SCHEMA)
    (row,) = dissolve.union_rings(df, "k", "rings", 3.0).collect()
    assert row.area == 81 and len(row.ring) == 8


def test_nothing(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", None), (None, [])], SCHEMA)):
        assert dissolve.union_area(df, "k", "rings", 5.0).count() == dissolve.union_rings(df, "k", "rings", 5.0).count() == 0
    df = spark.createDataFrame([(None, [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]])], SCHEMA)
    assert [tuple(r) for r in dissolve.union_area(df, "k", "rings", 5.0).select("k", F.round("area", 9)).collect()] == [(None, 0.5)]


@pytest.mark.parametrize("cell", [8.0, 64.0])
def test_set_operations_equal_pixels(spark, cell):
    r = random.Random(9)
    sides = [[(r.choice("abc"[k : k + 2]), r.randrange(40), r.randrange(40), r.randrange(2, 20), r.randrange(2, 20)) for _ in range(30)] for k in (0, 1)]
    frames = [spark.createDataFrame([(s[0], [ell(*s[1:])]) for s in side] + [(None, [ell(0, 0, 4, 4)])] * (1 - k), SCHEMA) for k, side in enumerate(sides)]
    found = [{k: set().union(*(pixels(*s[1:]) for s in side if s[0] == k)) for k in "abc"} for side in sides]
    found[0][None], found[1][None] = pixels(0, 0, 4, 4), set()
    for name, op in (("intersection", set.__and__), ("difference", set.__sub__), ("symmetric_difference", set.__xor__), ("union", set.__or__)):
        want = {k: op(found[0][k], found[1][k]) for k in ("a", "b", "c", None)}
        assert dict(dissolve.set_area(*frames, "k", "rings", name, cell).collect()) == {k: len(v) for k, v in want.items() if v}
        if name in ("difference", "intersection"):
            rows = dissolve.set_rings(*frames, "k", "rings", name, cell).collect()
            for k, v in want.items():
                rings = [np.array(x.ring).reshape(-1, 2) for x in rows if x.k == k]
                assert sum(np.abs(p - np.roll(p, -1, axis=0)).sum() for p in rings) == border(v)


@pytest.mark.parametrize("corners", [12, 2_048])
def test_set_areas_equal_pixels_in_crowded_cells_too(spark, corners, monkeypatch):
    monkeypatch.setattr(dissolve, "MOST_CORNERS", corners)  # with 12 most cells are united first
    r = random.Random(4)
    sides = [[(r.choice("ab"), 0 if i % 2 else r.randrange(-20, 40), 0 if i % 2 else r.randrange(-20, 40), r.randrange(2, 30), r.randrange(2, 30)) for i in range(40)] for _ in (0, 1)]
    frames = [spark.createDataFrame([(s[0], [ell(*s[1:])]) for s in side] + [("a", None), ("b", []), (None, [ell(3, 3, 4, 4)])], SCHEMA).repartition(3) for side in sides]
    found = [{k: set().union(*(pixels(*s[1:]) for s in side if s[0] == k)) for k in "ab"} | {None: pixels(3, 3, 4, 4)} for side in sides]
    got = {x.k: tuple(x)[1:] for x in dissolve.set_areas(*frames, "k", "rings", 16.0).collect()}
    assert got == {k: tuple(map(float, (len(a - b), len(a & b), len(b - a)))) for k in ("a", "b", None) for a, b in [(found[0][k], found[1][k])]}


def test_areas_are_measured_without_unions(spark, monkeypatch):
    monkeypatch.setattr(dissolve, "_united", lambda *_: pytest.fail("shapes were united to be measured"))
    df = spark.createDataFrame([("s", [ell(0, 0, 8 + k % 41, 8 + k % 29)]) for k in range(100)], SCHEMA)
    found = set().union(*(pixels(0, 0, 8 + k % 41, 8 + k % 29) for k in range(100)))
    assert dict(dissolve.set_area(df, df.limit(0), "k", "rings", "difference", 64.0).collect()) == {"s": len(found)}


@pytest.mark.parametrize("edges", [8, 1_024])
def test_covered_areas_of_general_shapes(edges, monkeypatch):
    monkeypatch.setattr(slabs, "GROUP_EDGES", edges)  # with 8 groups are cut into bands
    r, shapes = np.random.default_rng(6), []
    for _ in range(24):
        n = r.integers(3, 9)
        shapes.append(r.uniform(-2, 12, (n, 2)))  # crossing themselves, and over the border of the box
    group, side, box = np.arange(24) // 8, np.arange(24) % 2, np.array([[0.0, 0, 8, 8], [1, 1, 9, 9], [-1, 2, 7, 10]])
    xy, ring = slabs.ring_edges(np.concatenate(shapes), np.array([len(s) for s in shapes]))
    got = slabs.covered_areas(xy, ring, side, group, box)
    for g, b in enumerate(box):
        frame_ = [np.array([[b[0], b[1]], [b[2], b[1]], [b[2], b[3]], [b[0], b[3]]])]
        parts = [frame_, *([s] for s in shapes[8 * g : 8 * g + 8])]
        for k, keep in enumerate((lambda a, b: a & ~b, lambda a, b: a & b, lambda a, b: b & ~a)):
            want = combined(parts, lambda m, keep=keep: m[0] & keep(np.logical_or.reduce(m[1::2]), np.logical_or.reduce(m[2::2])))
            assert got[g, k] == pytest.approx(sum(ring_area(p) for p in want), abs=1e-5)


def test_regions_of_a_batch_are_clipped_as_each_alone():
    r, regions = np.random.default_rng(12), [None, [], [[0.0, 0.0, 5.0, 5.0]], [ell(0, 0, 16, 8)], [ell(-9, -20, 40, 33), [-5.0, -15.0, 0.0, -15.0, 0.0, -9.0]]]
    regions += [[(p + o).ravel().tolist() for p in np.split(r.uniform(-20, 30, (9, 2)), 3)] for o in r.uniform(-50, 50, (20, 2))]
    batch = pa.record_batch({"key": pa.array(range(len(regions))), "rings": pa.array(regions, pa.list_(pa.list_(pa.float64())))})
    got = [row for b in dissolve._clipped_batches(iter([batch, batch[:3]]), 8.0) for row in b.to_pylist()]
    want = {}
    for key, region in enumerate(regions):
        rings = dissolve.with_grid_corners(region or [], 8.0)
        for cx in range(-12, 14):
            for cy in range(-12, 14):
                if part := dissolve._cell_part(rings, cx, cy, 8.0):
                    want[key, cx, cy] = [p.ravel().tolist() for p in part]
    assert {(x["key"], x["cx"], x["cy"]): x["rings"] for x in got} == want and len(got) == len(want)


def test_shapes_of_a_union_are_clipped_at_once(spark, monkeypatch):
    monkeypatch.setattr(dissolve, "clip_ring", lambda *_: pytest.fail("a ring was clipped alone"))
    df = spark.createDataFrame([("s", [ell(3 * k, 0, 20, 20)]) for k in range(9)], SCHEMA)
    assert sum(x.area for x in dissolve.union_rings(df, "k", "rings", 16.0).collect()) == len(set().union(*(pixels(3 * k, 0, 20, 20) for k in range(9))))
