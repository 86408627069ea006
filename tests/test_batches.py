import numpy as np
import pytest

from tessella.functions import kernels as K
from tessella.functions import overlay as O
from tessella.functions.slabs import corner_areas, pair_areas

R = np.random.default_rng(4)


def ells(n):
    """Right-angled polygons of six corners, either way round."""
    out = []
    for _ in range(n):
        x, y, u, v = (int(k) for k in R.integers(1, 9, 4))
        ring = np.array([[0, 0], [x + u, 0], [x + u, y], [x, y], [x, y + v], [0, y + v]], float) + R.integers(-9, 9, 2)
        out.append(ring[::-1] if R.random() < 0.5 else np.roll(ring, int(R.integers(6)), axis=0))
    return out


def test_areas_by_corners_equal_those_by_slabs():
    a, b = ells(500), ells(500)
    got = corner_areas(np.array(a), np.array(b))
    assert (got == pair_areas([[x] for x in a], [[x] for x in b])).all() and (got > 0).sum() > 50


def test_other_polygons_are_left_to_the_slabs():
    twice = np.array([[0, 0], [4, 0], [4, 4], [1, 4], [1, 1], [3, 1], [3, 3], [0, 3]], float)  # part of its ground is wound about twice
    slanted = np.array([[0, 0], [4, 0], [4, 4], [2, 5], [1, 5], [0, 4], [0, 3], [0, 1]], float)
    on_side = np.array([[0, 0], [2, 0], [4, 0], [4, 2], [4, 4], [2, 4], [0, 4], [0, 2]], float)
    plain = np.array([[0, 0], [4, 0], [4, 4], [2, 4], [2, 2], [1, 2], [1, 4], [0, 4]], float)
    got = corner_areas(np.array([twice, slanted, on_side, plain]), np.array([plain] * 4))
    assert np.isnan(got[:3]).all() and got[3] == 14


def stars(n):
    for _ in range(n):
        t = np.sort(R.random(int(R.integers(3, 12)))) * 2 * np.pi
        q = 30 * (0.2 + 0.8 * R.random(len(t)))
        yield np.stack([20 + q * np.cos(t), 15 + q * np.sin(t)], axis=1)


def test_runs_of_a_batch_equal_those_of_masks():
    regions = [None, [], *([s] for s in stars(60)), *(list(stars(3)) for _ in range(20)), [np.array([[0, 0], [40, 0], [40, 30], [0, 30]], float)], [np.array([[-9, -9], [-5, -9], [-5, -3]], float)]]
    width, height = R.integers(20, 50, len(regions)), R.integers(20, 50, len(regions))
    want = [None if r is None else K.mask_runs(K.fill_polygons(r, int(w), int(h))) for r, w, h in zip(regions, width, height, strict=True)]
    assert K.fill_runs(regions, width, height) == want


def test_clipped_batch_equals_clipped_rings():
    rings = [*stars(200), np.empty((0, 2)), np.array([[15, 15], [16, 15], [16, 16]], float)]
    boxes = np.array([[*lo, *(lo + R.integers(3, 40, 2))] for lo in R.integers(-20, 40, (len(rings), 2))], float)
    points, sizes = K.clip_rings(np.concatenate(rings), np.array([len(r) for r in rings]), boxes)
    for got, ring, b in zip(np.split(points, np.cumsum(sizes)[:-1]), rings, boxes, strict=True):
        assert np.array_equal(got, K.clip_ring(ring, b))


def test_clip_column(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]), (2, None), (3, [9.0, 9.0, 10.0, 9.0, 10.0, 10.0])], "i int, flat array<double>")
    from pyspark.sql import functions as F

    got = {r.i: r.c for r in df.select("i", K.clip_to_box("flat", *map(F.lit, (1.0, 1.0, 3.0, 8.0))).alias("c")).collect()}
    assert got[2] is None and got[3] is None and K.ring_area(np.array(got[1]).reshape(-1, 2)) == pytest.approx(6)


def test_combined_batch_equals_combined_groups():
    groups = [[list(stars(int(R.integers(1, 3)))) for _ in range(int(R.integers(1, 6)))] for _ in range(40)] + [[[]], [], [[], list(stars(1))], [[x] for x in ells(9)]]
    groups.append([[x] for x in stars(120)])  # too many edges for a place beside others
    for keep, of_sides in ((np.logical_or, np.logical_or.reduce), (lambda a, b: a & ~b, lambda s: s[0] & ~np.logical_or.reduce([np.zeros(len(s[0]), bool), *s[1:]]))):
        for grain in (None, 2.0**-24):
            got = O.combined_many(groups, keep, grain)
            for g, rings in zip(groups, got, strict=True):
                want = O.combined(g, of_sides, grain) if g else []
                assert len(rings) == len(want) and all(np.array_equal(a, b) for a, b in zip(rings, want, strict=True))
