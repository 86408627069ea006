import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import affine as A
from tessella.functions import kernels as K
from tessella.functions import names as N
from tessella.functions import overlay as O
from tessella.functions import pixels as X
from tessella.functions import polygon as P
from tessella.functions import projection as J
from tessella.functions.rectilinear import Cells

L_SHAPE = [0, 0, 4, 0, 4, 1, 1, 1, 1, 4, 0, 4]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_intersection_areas():
    ring = lambda *v: np.array(v, float).reshape(-1, 2)
    a = ring(*L_SHAPE)
    assert K.intersection_area(a, a) == pytest.approx(7)
    assert K.intersection_area(a, ring(0, 0, 2, 0, 2, 2, 0, 2)) == pytest.approx(3)
    assert K.intersection_area(a, ring(2, 2, 3, 2, 3, 3, 2, 3)) == pytest.approx(0)
    assert K.intersection_area(a, ring(4, 0, 6, 0, 6, 1, 4, 1)) == 0
    r = random.Random(0)
    for _ in range(60):
        b, c = ([r.randrange(9), r.randrange(9)] for _ in range(2))
        boxes = [(x, y, x + r.randrange(1, 6), y + r.randrange(1, 6)) for x, y in (b, c)]
        p, q = (ring(x0, y0, x1, y0, x1, y1, x0, y1) for x0, y0, x1, y1 in boxes)
        assert K.intersection_area(p, q[::-1]) == pytest.approx(Cells.of_box(*boxes[0]).intersection_area(Cells.of_box(*boxes[1])))
        assert abs(K.ring_area(K.clip_ring(p, boxes[1]))) == pytest.approx(K.intersection_area(p, q))


def test_cells_cut_and_part():
    whole = Cells.of_box(0, 0, 10, 4)
    rest = whole.minus(Cells.of_box(4, -1, 6, 5))
    assert rest.area == 32 and sorted(p.area for p in rest.parts()) == [16, 16]
    assert whole.minus(whole).area == 0 and len(whole.minus(Cells.of_box(1, 1, 2, 2)).parts()) == 1


def test_masks_runs_and_outlines():
    r = np.random.default_rng(0)
    for _ in range(30):
        mask = r.random((7, 9)) < r.choice([0.1, 0.5, 0.9])
        assert (K.runs_mask(K.mask_runs(mask), 7) == mask).all() if mask.any() else True
        total = sum(K.ring_area(x) for x in K.outlines(mask))
        assert total >= mask.sum() and (total > 0) == mask.any()
    box = np.array([[1, 2], [5, 2], [5, 4], [1, 4]], float)
    mask = K.fill_polygons([box], 8, 6)
    assert mask.sum() == 5 * 3 and mask[2:5, 1:6].all()
    (outline,) = K.outlines(mask)
    assert K.ring_area(outline) == 15 and len(outline) == 4
    assert len(K.simplified(np.array([[0, 0], [5, 0.2], [10, 0], [10, 10], [0, 10]], float), 1.0)) == 4


def test_largest_rectangle_matches_brute_force():
    r = np.random.default_rng(1)
    for _ in range(40):
        m = r.random((5, 6)) < 0.7
        want = max((y1 - y0) * (x1 - x0) for y0, y1 in itertools.combinations(range(6), 2) for x0, x1 in itertools.combinations(range(7), 2) if m[y0:y1, x0:x1].all()) if m.any() else 0
        x0, y0, x1, y1 = K.largest_rectangle(m)
        assert (x1 - x0) * (y1 - y0) == want and m[y0:y1, x0:x1].all()


def test_overlays():
    r = random.Random(3)
    total = lambda rings: sum(K.ring_area(x) for x in rings)
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    hole = O.difference([square], [square / 2 + 1])
    assert sorted(map(K.ring_area, hole)) == [-4, 16] and len(O.Region(hole).parts()) == 1
    assert total(O.difference([square], [square])) == 0 and total(O.union([square], [square])) == 16
    assert sorted(map(K.ring_area, O.union([square], [square + (4, 0)]))) == [32]
    assert total(O.repaired([np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)])) == pytest.approx(8)
    for _ in range(80):
        star = lambda: np.array([[math.cos(t) * (q := r.uniform(1, 4)) + 5, math.sin(t) * q + 5] for t in (k * 0.8976 + r.uniform(0, 0.8) for k in range(7))])
        a, b = star(), star() + (r.uniform(-2, 2), 0)
        common = K.intersection_area(a, b)
        assert total(O.intersection([a], [b])) == pytest.approx(common, abs=1e-5)
        assert total(O.union([a], [b])) == pytest.approx(abs(K.ring_area(a)) + abs(K.ring_area(b)) - common, abs=1e-5)
        assert total(O.difference([a], [b])) == pytest.approx(abs(K.ring_area(a)) - common, abs=1e-5)


def test_kernels_in_a_frame(spark):
    df = spark.createDataFrame([(1, [float(v) for v in L_SHAPE]), (2, None)], "id int, flat array<double>")
    out = df.select("id", "flat", K.polygon_intersection_area("flat", F.array(*map(F.lit, (0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0)))).alias("a"), K.clip_to_box("flat", F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("c"), K.polygon_runs(F.when(F.col("flat").isNotNull(), F.array("flat")), F.lit(8), F.lit(8)).alias("r"))
    rows = {r.id: r for r in out.withColumn("p", K.runs_polygon("r", F.lit(8), F.lit(0.5))).withColumn("i", K.inner_rectangle(F.when(F.col("flat").isNotNull(), F.array("flat")), F.lit(8))).collect()}
    assert rows[1].a == pytest.approx(3) and abs(K.ring_area(K._ring(rows[1].c))) == pytest.approx(3)
    assert sum(rows[1].r) == 64 and sum(rows[1].r[1::2]) == 16 and len(rows[1].p) == 1 and rows[1].i == [0, 0, 5, 2]
    assert rows[2].a is None and rows[2].c is None and rows[2].p == []


def test_polygon_expressions(spark):
    flat = F.array(*[F.lit(float(v)) for v in L_SHAPE])
    shape = P.of_coco(F.array(flat))
    hole = F.array(F.array(P.ring_of_coco(F.array(*map(F.lit, (0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0)))), P.ring_of_coco(F.array(*map(F.lit, (2.0, 2.0, 4.0, 2.0, 4.0, 4.0, 2.0, 4.0))))))
    r = one(spark, P.area(shape), P.bounds(shape), P.ring_centroid(shape[0][0]), P.area(hole), P.area(P.without_rings(hole)), P.to_coco(shape),
            P.shape_contains(hole, F.lit(3.0), F.lit(3.0)), P.shape_contains(hole, F.lit(5.0), F.lit(3.0)), P.distance_to_ring(shape[0][0], F.lit(6.0), F.lit(0.5)),
            P.area(P.largest_part(F.concat(shape, hole))), P.single_part(F.concat(shape, hole)), F.size(P.without_small_parts(F.concat(shape, hole), 7.5)), P.bounds(P.normalised(shape)))
    assert (r.c0, tuple(r.c1)) == (7.0, (0, 0, 4, 4)) and r.c2.x == pytest.approx((2 * 4 + 0.5 * 3) / 7) and (r.c3, r.c4) == (77.0, 81.0)
    assert r.c5 == [[float(v) for v in L_SHAPE]] and (r.c6, r.c7, r.c8) == (False, True, 2.0)
    assert (r.c9, r.c10, r.c11) == (77.0, None, 1) and tuple(r.c12) == (0, 0, 100, 100)


def test_projection_round_trip_and_known_points(spark):
    # the equator on a central meridian, and the published length of its first half degree
    x, y = J.to_utm(F.lit(-75.0), F.lit(0.0), 32618)
    lon, lat = J.from_utm(*J.to_utm(F.lit(-73.57), F.lit(45.51), 32618), 32618)
    south = J.to_utm(F.lit(-75.0), F.lit(-0.5), 32718)
    r = one(spark, x, y, lon, lat, south[1])
    assert (r.c0, r.c1) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert (r.c2, r.c3) == (pytest.approx(-73.57, abs=1e-9), pytest.approx(45.51, abs=1e-9))
    assert 10_000_000 - r.c4 == pytest.approx(0.9996 * 55287.15, abs=0.5)
    with pytest.raises(ValueError, match="EPSG:3857"):
        J.reproject(F.lit(0.0), F.lit(0.0), 4326, 3857)
    assert J.reproject(1, 2, None, 32618) == (1, 2)


def test_affine_and_names(spark):
    t = A.affine(2, 0, 10, 0, -2, 50)
    back = A.forward(A.inverse(t), *A.forward(t, F.lit(3.0), F.lit(4.0)))
    singular = A.inverse(A.affine(1, 1, 0, 1, 1, 0))["a"]
    r = one(spark, *back, singular, N.strip_extensions(F.lit("/a/b.c/name.tar.gz")), N.product_name(F.lit("My--Product name")), N.specifier(ground_resolution=0.05, voxel_size=0.1),
            N.coco_name(F.lit("p_q"), N.specifier(scale_factor=1), F.lit("train")), N.cloud_tile_name(F.lit("p"), F.lit("gr0p05_vs0p1"), F.lit("3"), F.lit("4")), N.vector_name(F.lit("p"), F.lit("sf1p0"), F.lit("x"), "gpkg"), N.aoi_image_name(F.lit("p"), F.lit("sf1p0")))
    assert (r.c0, r.c1, r.c2) == (pytest.approx(3), pytest.approx(4), None) and (r.c3, r.c4, r.c5) == ("name", "my_product_name", "gr0p05_vs0p1")
    assert (r.c6, r.c7, r.c8, r.c9) == ("p_q_coco_sf1p0_train.json", "p_pctile_noaoi_gr0p05_vs0p1_3_4.pcd", "p_sf1p0_x.gpkg", "p_aoistiles_sf1p0.png")
    old = [("a_b_tile_train_512_gr0p1_3_4.tif", "train", 512, 3), ("a_b_tile_noaoi_sf0p5_3_4.tif", None, None, 3), ("a_b_tile_sf0p5_3_4.tif", None, None, 3), ("bad.tif", None, None, None)]
    df = spark.createDataFrame([(n,) for n, *_ in old], "name string")
    fields = N.parse_tile_name(F.col("name"))
    got = {r.name: (r.aoi, r.width, r.col) for r in df.select("name", *[fields[k].alias(k) for k in ("aoi", "width", "col")]).collect()}
    assert got == {n: tuple(v) for n, *v in old}
    spec = N.parse_name(N.CLOUD_COCO, F.lit("p_pccoco_sf0p5_vs0p1_train.json"))
    r = one(spark, spec["product"], spec["fold"], spec["scale_factor"], spec["voxel_size"])
    assert tuple(r) == ("p", "train", 0.5, 0.1)
    with pytest.raises(Exception, match="not a product name"):
        one(spark, N.product_name(F.lit("a/b")))


def test_names_are_read_once(spark):
    from tessella.operators.grid import tile_grid

    name = "a_b_tile_train_sf0p5_-3_4_128_64_77.tif"
    rows = [(name,), (name + "\n",), ("\x01",), (None,), ("p_tile_x_32_gr0p1_3_4.tif",)]
    df = spark.createDataFrame(rows, "name string").coalesce(1)
    got = df.select("name", *[c.alias(k) for k, c in N.parse_tile_name(F.col("name")).items()])
    read = [tuple(r)[1:] for r in got.collect()]
    full, none = ("a_b", "train", -3, 4, 128, 64, 77, 0.5, None), (None,) * 9
    assert read == [full, full, none, none, ("p", "x", 3, 4, 32, 32, None, None, 0.1)]
    # a file of few rasters is one task, and stands for many tiles
    few = spark.range(64, numPartitions=1).selectExpr("id as raster_id", "1000 as w", "1000 as h")
    assert tile_grid(few, 128).select(F.spark_partition_id()).distinct().count() > 1


def test_pixels(spark):
    ints = lambda *v: F.array(*map(F.lit, v))
    r = one(spark, X.float_to_byte(ints(0.5, 0.1, 1.0)), X.float_to_byte(ints(0.5, math.nan, 1.0)), X.float_to_byte(ints(-3.0, 300.0, 2.7)), X.wide_to_byte(ints(-5, 70000, 65535, 9999), 9999), X.short_to_byte(ints(256, 65535)), X.short_to_byte(ints(3, 255)), X.colour_to_byte(F.lit(65535)), X.and_masks(ints(1, 1, 0), ints(1, 0, 0)), X.masked(ints(5, 6), ints(0, 1)), X.empty_share([ints(0, 255, 9), ints(0, 255, 0), ints(0, 255, 0), ints(1, 1, 0)]))
    # a missing value counts as 255, so the rest is taken for bytes already
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5, r.c6) == ([128, 26, 255], [0, 255, 1], [0, 255, 2], [0, 255, 255, 0], [1, 255], [3, 255], 255)
    assert (r.c7, r.c8, r.c9) == ([1, 0, 0], [0, 6], 1.0)
