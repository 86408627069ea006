import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import affine as A
from tessella.operators import coco, grid
from tessella.plans import pipelines


def square(x, y, s, t=None):
    return [float(v) for v in (x, y, x + s, y, x + s, y + (t or s), x, y + (t or s))]


def test_ordered_tiles(spark):
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "file_name string")
    assert {tuple(r) for r in coco.ordered_tiles(names).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    order = spark.createDataFrame([("c", 5), ("x", 6), ("a", 9), ("c", 20), (None, 1)], "file_name string, place int")
    assert {tuple(r) for r in coco.ordered_tiles(names, order, 1).collect()} == {("c", 1), ("a", 2)}
    assert coco.ordered_tiles(names.where("false"), order).count() == 0
    tiles = names.where("file_name is not null").distinct().select("file_name", F.lit(3).alias("width"), F.lit(4).alias("height"))
    assert {tuple(r) for r in coco.images_of(tiles, order).collect()} == {(1, 3, 4, "c"), (2, 3, 4, "a")}


def walk(rows, num, den):
    kept = []
    for name, x, y, s, score in sorted(rows, key=lambda r: -r[4]):
        def over(k):
            c = max(min(x + s, k[1] + k[3]) - max(x, k[1]), 0) * max(min(y + s, k[2] + k[3]) - max(y, k[2]), 0)
            return den * c > num * (s * s + k[3] * k[3] - c)
        if score >= 0.1 and not any(over(k) for k in kept):
            kept.append((name, x, y, s, score))
    return kept


def test_predictions_that_are_rows(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.randrange(60), r.randrange(60), r.randrange(2, 20), round(r.random(), 6)) for _ in range(120)]
    df = spark.createDataFrame([(n, square(x, y, s), v) for n, x, y, s, v in rows] + [("a", None, 0.9), ("a", [1.0, 2.0], 0.9)], "file_name string, flat array<double>, score double").repartition(3)
    got = pipelines.from_shapes(df, nms_threshold=(3, 10)).select("file_name", "flat", "score", "tile_idx").collect()
    want = walk(rows, 3, 10)
    assert sorted((x.file_name, tuple(x.flat)) for x in got) == sorted((n, tuple(square(x, y, s))) for n, x, y, s, _ in want)
    assert {(x.file_name, x.tile_idx) for x in got} <= {("a", 0), ("b", 1), ("c", 2)}
    # in pixels of tiles that are placed apart nothing of different tiles meets; the edge band drops what leaves it
    tiles = spark.createDataFrame([(n, 80, 80, 1000.0 * i) for i, n in enumerate("abc")], "file_name string, width int, height int, c double")
    tiles = tiles.select("file_name", "width", "height", A.affine(2.0, 0.0, F.col("c"), 0.0, -2.0, 500.0).alias("transform"))
    apart = pipelines.from_shapes(df, tiles, nms_threshold=(3, 10), edge_band=0.05).collect()
    inner = [q for q in rows if min(q[1], q[2]) >= 4 and max(q[1], q[2]) + q[3] <= 76]
    assert len(apart) == sum(len(walk([q for q in inner if q[0] == n], 3, 10)) for n in "abc")
    chosen = pipelines.from_shapes(df, order=spark.createDataFrame([("b", 1)], "file_name string, place int"), nms_threshold=(3, 10))
    assert {tuple(x) for x in chosen.select("file_name", "tile_idx").distinct().collect()} == {("b", 0)}


def test_reference_grid_of_a_rotated_raster(spark):
    own = spark.range(1).select(F.col("id").alias("raster_id"), F.lit(10).alias("width"), F.lit(20).alias("height"), A.affine(0.0, 3.0, 5.0, 4.0, 0.0, 7.0).alias("transform"))
    rows = grid.reference_grid(own, 5).collect()
    assert {(r.x_resolution, r.y_resolution) for r in rows} == {(4.0, 3.0)} and len(rows) == 3 * 2
    assert min(r.tile.minx for r in rows) == 5 and min(r.tile.miny for r in rows) == 7 and {r.tile.maxx - r.tile.minx for r in rows} == {20.0}


@pytest.mark.parametrize("size", [1])
def test_reference_grid_of_nothing(spark, size):
    own = spark.range(1).select(F.col("id").alias("raster_id"), F.lit(0).alias("width"), F.lit(5).alias("height"), A.affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0).alias("transform"))
    assert grid.reference_grid(own, size).count() == 0
