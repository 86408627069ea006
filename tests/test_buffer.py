import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import buffer as B
from tessella.functions.kernels import ring_area
from tessella.functions.overlay import _edges, inside

SQUARE = np.array([[0, 0], [10, 0], [10, 6], [0, 6]], float)
ELL = np.array([[0, 0], [12, 0], [12, 6], [6, 6], [6, 12], [0, 12]], float)


def part(d, quarter, turn=np.pi / 2):
    """Area of a polygonal arc's fan."""
    n = int(np.ceil(turn / (np.pi / 2) * quarter - 1e-9))
    return d * d / 2 * n * np.sin(turn / n)


def area(rings):
    return sum(ring_area(r) for r in rings)


@pytest.mark.parametrize("quarter", [1, 8, 16])
def test_areas_equal_the_polygonal_formula(quarter):
    for ring in (SQUARE, SQUARE[::-1]):
        assert area(B.buffered([ring], 2, quarter)) == pytest.approx(60 + 32 * 2 + 4 * part(2, quarter), rel=1e-7)
        assert area(B.buffered([ring], -2, quarter)) == pytest.approx(6 * 2, rel=1e-7)
    assert area(B.buffered([ELL], 2, quarter)) == pytest.approx(108 + 48 * 2 - 4 + 5 * part(2, quarter), rel=1e-7)
    assert area(B.buffered([ELL], -2, quarter)) == pytest.approx(108 - 48 * 2 + 5 * 4 - part(2, quarter), rel=1e-7)
    triangle = np.array([[0, 0], [8, 0], [0, 6]], float)
    turns = [np.pi / 2, np.pi - np.arctan2(6, 8), np.pi - np.arctan2(8, 6)]
    assert area(B.buffered([triangle], 1.5, quarter)) == pytest.approx(24 + 24 * 1.5 + sum(part(1.5, quarter, t) for t in turns), rel=1e-7)


def test_holes_shrink_and_vanish():
    hole = np.array([[3, 2], [7, 2], [7, 4], [3, 4]], float)
    assert area(B.buffered([SQUARE, hole], 0.5, 8)) == pytest.approx(60 + 16 + 4 * part(0.5, 8) - 3 * 1, rel=1e-7)
    assert area(B.buffered([SQUARE, hole], 1, 8)) == pytest.approx(60 + 32 + 4 * part(1, 8), rel=1e-7)
    assert B.buffered([SQUARE], -3, 8) == [] and B.buffered([], 1) == []


def test_membership_is_distance():
    r = np.random.default_rng(2)
    t = np.sort(r.random(14)) * 2 * np.pi
    q = 10 * (0.3 + 0.7 * r.random(14))
    star = np.stack([q * np.cos(t), q * np.sin(t)], axis=1)
    at = r.uniform(-14, 14, (4000, 2))
    a, d = star, np.roll(star, -1, axis=0) - star
    along = np.clip(((at[:, None] - a) * d).sum(2) / (d * d).sum(1), 0, 1)
    far = np.hypot(*np.moveaxis(at[:, None] - a - along[..., None] * d, 2, 0)).min(axis=1)
    within = inside(at, _edges([star]))
    for by in (1.5, -0.8):
        want = within | (far <= by) if by > 0 else within & (far >= -by)
        got = inside(at, np.concatenate([np.empty((0, 2, 2)), _edges(B.buffered([star], by, 32))]))
        clear = np.abs(far - abs(by)) > 0.01  # chords stay a little inside of arcs
        assert (got == want)[clear].all()


def test_column(spark):
    df = spark.createDataFrame([(1, [SQUARE.ravel().tolist()]), (2, None), (3, [])], "i int, rings array<array<double>>")
    got = {r.i: r.b for r in df.select("i", B.buffer(F.col("rings"), 1.0).alias("b")).collect()}
    assert area([np.array(x).reshape(-1, 2) for x in got[1]]) == pytest.approx(60 + 32 + 4 * part(1, 8)) and got[2] is None and got[3] == []


def lists(regions, by):
    """Areas of a batch of regions, as the column makes them."""
    got = B._buffered_lists(pa.array(regions, pa.list_(pa.list_(pa.float64()))), np.asarray(by, float), 8).to_pylist()
    return [None if g is None else area([np.array(x).reshape(-1, 2) for x in g]) for g in got]


def test_plain_rings_need_no_overlay(monkeypatch):
    monkeypatch.setattr(B, "combined_many", lambda groups, *_: [] if not groups else pytest.fail("a plain ring was cleaned"))
    rings = [r * s for s in (1.0, 3.0) for r in (ELL, ELL[::-1], SQUARE)]
    got = lists([[r.ravel().tolist()] for r in rings], [2.0] * 6)
    sides = [(108, 48, 4, 5), (108, 48, 4, 5), (60, 32, 0, 4)]
    assert got == pytest.approx([s * s * a + s * p * 2 - less + n * part(2, 8) for s in (1, 3) for a, p, less, n in sides])
    assert lists([[ELL.ravel().tolist()]], [-2.0]) == pytest.approx([108 - 48 * 2 + 5 * 4 - part(2, 8)])


def test_batches_equal_the_overlay():
    r, regions = np.random.default_rng(3), [None, [], [SQUARE.ravel().tolist(), [3.0, 2.0, 7.0, 2.0, 7.0, 4.0, 3.0, 4.0]], [[0.0, 0.0, 4.0, 0.0]], [[0.0, 0.0, 4.0, 4.0, 4.0, 0.0, 0.0, 4.0]]]
    # a gap and a neck that sweeps close
    regions += [[[0.0, 0, 9, 0, 9, 8, 6, 8, 6, 2, 3, 2, 3, 8, 0, 8]], [[0.0, 0, 4, 0, 4, 3, 9, 3, 9, 0, 13, 0, 13, 8, 9, 8, 9, 4, 4, 4, 4, 8, 0, 8]]]
    for k in range(60):
        n = r.integers(3, 12)
        t, q = np.sort(r.random(n)) * 2 * np.pi, 10 * (0.3 + 0.7 * r.random(n))
        star = np.stack([100 + q * np.cos(t), q * np.sin(t)], axis=1) if k % 5 else r.random((n, 2)) * 10
        regions.append([(star[::-1] if k % 2 else star).ravel().tolist()])
    for by in (3.0, 1.5, 0.2, -0.2, -0.6, -3.0):
        want = [None if x is None else area(B.buffered([np.array(y).reshape(-1, 2) for y in x], by)) for x in regions]
        got = lists(regions, [by] * len(regions))
        assert got[0] is None and got[1:] == pytest.approx(want[1:], rel=1e-6, abs=1e-6)
    assert lists(regions[:3], [1.0, float("nan"), 0.0]) == [None, None, pytest.approx(52)]
