import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.overlay import _edges, inside
from tessella.operators import locate

POINTS, REGIONS = "point_id long, s string, x double, y double", "label_id long, t string, category string, rings array<array<double>>"


def star(r, n, x, y, size):
    t = np.sort(r.random(n)) * 2 * np.pi
    q = size * (0.3 + 0.7 * r.random(n))
    return np.stack([x + q * np.cos(t), y + q * np.sin(t)], axis=1)


def data():
    r = np.random.default_rng(3)
    regions = [(i, "ab"[i % 2], f"c{i % 3}", [star(r, int(r.integers(3, 60)), *r.uniform(0, 100, 2), float(2 ** r.uniform(0, 6)))]) for i in range(40)]
    regions.append((90, "a", "holed", [np.array([[0, 0], [90, 0], [90, 90], [0, 90]], float), star(r, 30, 45, 45, 40), star(r, 9, 200, 200, 30)]))
    points = [(i, "ab"[i % 2], *map(float, r.uniform(-10, 220, 2))) for i in range(1200)]
    return points, regions


def frames(spark, points, regions):
    rows = [(i, t, c, rings and [p.ravel().tolist() for p in rings]) for i, t, c, rings in regions]
    return spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(rows, REGIONS)


@pytest.mark.parametrize("scoped", [False, True])
def test_points_in_general_regions_with_holes(spark, scoped):
    points, regions = data()
    at = np.array([p[2:] for p in points])
    want = {(points[k][0], i) for i, t, _, rings in regions for k in np.flatnonzero(inside(at, np.concatenate([_edges([p]) for p in rings]))) if not scoped or points[k][1] == t}
    got = locate.located(*frames(spark, points, regions), scope=("s", "t") if scoped else None).collect()
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want


def test_bands_hold_few_edges(spark):
    r = np.random.default_rng(1)
    g = np.linspace(0, 2 * np.pi, 4001)[:-1]
    ring = np.stack([np.cos(g), np.sin(g)], axis=1) * 100 + r.normal(0, 0.01, (4000, 2))
    _, edges = locate.edge_index(spark.createDataFrame([(1, "a", "c", [ring.ravel().tolist()])], REGIONS), "label_id", "rings")
    counts = edges.groupBy("band").count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    assert counts[0] < 200 and counts[1] < 8000 and counts[2] > 900


def test_labels_of_points(spark):
    square = lambda x, y, s: [float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]
    regions = spark.createDataFrame([(7, "a", "big", [square(0, 0, 10)]), (3, "a", "small", [square(4, 4, 2)]), (8, "a", None, [square(20, 0, 5)]), (9, "a", "none", None), (10, "a", "flat", [[0.0, 0.0, 5.0, 0.0, 9.0, 0.0]])], REGIONS)
    points = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", 5.0, 5.0), (3, "a", 22.0, 1.0), (4, "a", 50.0, 1.0), (5, "a", None, 1.0)], POINTS).withColumn("hit_point", F.lit("kept"))
    got = {r.point_id: (r.label_id, r.category, r.hit_point) for r in locate.labelled(points, regions).collect()}
    assert got == {1: (7, "big", "kept"), 2: (3, "small", "kept"), 3: (8, None, "kept"), 4: (None, None, "kept"), 5: (None, None, "kept")}
    assert locate.located(points.where("false"), regions).count() == locate.located(points, regions.where("false")).count() == 0


def test_points_of_one_place_and_regions_of_one_shape_are_judged_once(spark):
    square = [[0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]]
    points = spark.range(4000).select(F.col("id").alias("point_id"), F.lit("a").alias("s"), (F.col("id") % 4).cast("double").alias("x"), F.lit(1.0).alias("y"))
    regions = spark.range(300).select(F.col("id").alias("label_id"), F.lit("a").alias("t"), F.lit("c").alias("category"), F.array(F.array(*map(F.lit, square[0]))).alias("rings"))
    pairs, *_ = locate._met(points, regions, "label_id", "rings", "point_id", None)
    assert pairs.count() == 2
    got = locate.located(points, regions)
    assert got.count() == got.distinct().count() == 2000 * 300
    assert got.where("point_id % 4 > 1").isEmpty()
