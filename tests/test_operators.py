import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.box import box
from tessella.operators import aoi, cloud, coco, datasets, grid, nms, raster, spatial, taxonomy
from tessella.plans import bindings as T
from tessella.plans import pipelines
from tessella.streaming import arrivals

SF = "/root/testdata/sf0.001"


def boxes(spark, n, seed=0, size=100):
    r = random.Random(seed)
    rows = [(i, (x := r.randrange(size)), (y := r.randrange(size)), x + r.randrange(1, 25), y + r.randrange(1, 25), r.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "pred_id long, minx int, miny int, maxx int, maxy int, score double")
    return rows, df.select("pred_id", "score", box("minx", "miny", "maxx", "maxy").alias("shape"))


def test_cell_join_gives_each_pair_once_at_any_cell_size(spark):
    rows, df = boxes(spark, 60)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    for cell in (3.0, 16.0, 1000.0):
        got = [(r.pred_id, r.other_pred_id) for r in spatial.self_pairs(df, "pred_id", "shape", cell=cell).collect()]
        assert len(got) == len(want) and set(got) == want


def test_greedy_walk(spark):
    rows, df = boxes(spark, 80, 1, 60)

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        c = max(w, 0) * max(h, 0)
        return c / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - c)

    kept = []
    for a in sorted(rows, key=lambda r: (-r[5], r[0])):
        if all(iou(a, b) <= 0.2 for b in kept):
            kept.append(a)
    assert {r.pred_id for r in nms.greedy_nms(df, 1, 5, cell=20.0).collect()} == {a[0] for a in kept}
    assert nms.greedy_nms(df.where("false"), 1, 5).count() == 0


def test_disambiguation_leaves_no_common_ground(spark):
    _, df = boxes(spark, 60, 2, 60)
    got = nms.ioa_disambiguated(df, 0.6, 0.5, cell=20.0).collect()
    flat = [(r.pred_id, b) for r in got for b in r.pieces]
    for i, (p, a) in enumerate(flat):
        for q, b in flat[:i]:
            assert p == q or min(a[2], b[2]) <= max(a[0], b[0]) or min(a[3], b[3]) <= max(a[1], b[1])
    polygons = df.withColumn("flat", coco.box_to_coco(F.col("shape"))[0].cast("array<double>"))
    other = {r.pred_id: r.area for r in nms.ioa_disambiguated(polygons, 0.6, 0.5, cell=20.0, flat="flat").collect()}
    assert {k: pytest.approx(v, abs=1e-4) for k, v in other.items()} == {r.pred_id: r.area for r in got}
    two = spark.createDataFrame([(1, 0.9, 4, 0, 6, 9), (2, 0.5, 0, 2, 11, 4), (3, 0.4, 4, 1, 6, 3)], "pred_id long, score double, minx int, miny int, maxx int, maxy int")
    two = two.select("pred_id", "score", box("minx", "miny", "maxx", "maxy").alias("shape"))
    assert {r.pred_id: r.area for r in nms.ioa_disambiguated(two).collect()} == {1: 18.0, 2: 10.0}


def test_area_checks():
    bad = [
        [], [aoi.Aoi("a b", 0.5)], [aoi.Aoi("a", 0.7), aoi.Aoi("b", 0.7)], [aoi.Aoi("a", 0.5, 1), aoi.Aoi("b", 0.5)],
        [aoi.Aoi("a", 0.5, priority=True), aoi.Aoi("b", 0.5, priority=True)], [aoi.Aoi("a", 0.0)],
    ]
    for areas in bad:
        with pytest.raises(ValueError):
            aoi.check_aois(areas)
    with pytest.raises(ValueError, match="corners"):
        aoi.check_aois([aoi.Aoi(c, 0.2) for c in "abcde"], "corner")


def test_quotas_sum_to_the_tiles(spark):
    areas = [aoi.Aoi("a", 0.495), aoi.Aoi("b", 0.01), aoi.Aoi("c", 0.495)]
    got = {}
    for r in aoi.quotas(spark.range(0, 40).selectExpr("id as raster_id", "id as n"), areas).collect():
        got.setdefault(r.raster_id, {})[r.aoi] = r.quota
    assert all(sum(q.values()) == n for n, q in got.items())
    assert got[2] == {"a": 1, "b": 0, "c": 1} and got[1] == {"a": 1, "b": 0, "c": 0} and got[7] == {"a": 4, "b": 0, "c": 3}


def test_corner_grows_from_its_corner(spark):
    tiles = grid.tile_grid(spark.createDataFrame([(1, 60, 60)], "raster_id long, w int, h int"), 10)
    got = {(r.row // 10, r.col // 10): r.aoi for r in aoi.corner(tiles, [aoi.Aoi("a", 0.25, 1), aoi.Aoi("b", 0.25, 2), aoi.Aoi("c", 0.5, 3)], 10).collect()}
    assert all(got[i, j] == "a" for i in range(3) for j in range(3)) and all(got[i, 5 - j] == "b" for i in range(3) for j in range(3))
    assert sorted(got.values()).count("c") == 18


def test_grid_limits(spark):
    with pytest.raises(ValueError, match="step"):
        grid.step_of(10, 0.95)
    one = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0)], "cloud_id int, minx double, miny double, maxx double, maxy double")
    with pytest.raises(ValueError, match="more than 3"):
        grid.within_limit(grid.cloud_grid(one, 1.0), 3)
    assert grid.within_limit(grid.cloud_grid(one, 1.0), 3, force=True).count() == 100
    idx = grid.dense_index(spark.range(1000).withColumn("k", -F.col("id")), "k").collect()
    assert sorted((r.k, r.idx) for r in idx) == [(k, i) for i, k in enumerate(range(-999, 1))]


def test_windows_of_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, 0, [float(v) for v in range(16)]), (1, 0, 1, [100.0 + v for v in range(16)])], "raster_id long, block_row long, block_col long, pixels array<double>")
    tiles = spark.createDataFrame([(1, 0, 2, 1, 6, 5)], "raster_id long, tile_id long, minx long, miny long, maxx long, maxy long").select("raster_id", "tile_id", box("minx", "miny", "maxx", "maxy").alias("tile"))
    (got,) = raster.windows_of_blocks(tiles, blocks, 4).collect()
    assert got.pixels == [6, 7, 104, 105, 10, 11, 108, 109, 14, 15, 112, 113, 0, 0, 0, 0]


def test_categories_and_folds(spark):
    cats = spark.createDataFrame([(1, "oak", ["quercus"]), (2, "elm", None)], "id long, name string, other_names array<string>")
    own = coco.with_category_id(spark.createDataFrame([("quercus",), ("elm",), ("ash",), (None,)], "category string"), coco.category_ids(cats))
    assert {r.category: r.category_id for r in own.collect()} == {"quercus": 1, "elm": 2, "ash": -1, None: -1}
    with pytest.raises(ValueError, match="more than once"):
        coco.category_ids(cats.unionByName(cats))
    images = spark.range(1, 23)
    parts = coco.folds(images, 4, seed=3).collect()
    valid = {(r.image_id, r.fold) for r in parts if r.part == "valid"}
    assert len(parts) == 88 and sorted(i for i, _ in valid) == list(range(1, 23)) and {f for _, f in valid} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="no fold for image"):
        coco.folds(images, 4, predefined=spark.createDataFrame([(1, 0)], "image_id long, own_fold int")).collect()


def test_taxonomy_keeps_known_ids(spark):
    rows = spark.createDataFrame([("F", "G", "s1"), ("F", "G", None), ("E", "H", "s2"), ("F", None, "lost")], "family string, genus string, species string")
    tree = taxonomy.built(rows)
    names = {r.name: (r.id, r.supercategory) for r in tree.collect()}
    assert names == {"E": (1, None), "F": (2, None), "H": (3, 1), "G": (4, 2), "s2": (5, 3), "s1": (6, 4)}
    base = spark.createDataFrame([(9, "F", "FAMILY", None), (7, "x", None, None)], "id long, name string, rank string, supercategory long")
    got = {r.name: (r.id, r.supercategory) for r in taxonomy.merged(base, tree).collect()}
    assert got == {"F": (9, None), "E": (10, None), "H": (11, 10), "G": (12, 9), "s2": (13, 11), "s1": (14, 12)}


def test_datasets(spark):
    items = spark.createDataFrame([(1, "b"), (0, "a")], "tile_idx long, name string")
    d = datasets.TileDataset(items, lambda r: r | {"name": r["name"].upper()})
    assert len(d) == 2 and [r.name for r in d] == ["A", "B"] and d[1].name == "B"
    with pytest.raises(IndexError):
        d[5]


def test_labeled_dataset_and_its_files(spark, tmp_path):
    rasters = T.rasters(spark, SF).where("raster_id < 3").withColumn("product", F.concat(F.lit("r"), F.col("raster_id")))
    how = pipelines.Tiling(128, 0.25, [aoi.Aoi("train", 0.8, 1), aoi.Aoi("valid", 0.2, 2)])
    rows = T.labels(spark, SF).where("raster_id < 3")
    doc = pipelines.labeled_dataset(rasters, rows, how)
    assert doc.tiles.groupBy("aoi").count().count() == 2
    assert doc.labels.join(doc.tiles, ["raster_id", "tile_id"], "left_anti").count() == 0
    (path,) = doc.write(str(tmp_path), "r", "sf1p0", ["valid"])
    out = json.loads((tmp_path / path.rsplit("/", 1)[1]).read_text())
    assert len(out["annotations"]) == doc.labels.where("aoi = 'valid'").count() and {c["name"] for c in out["categories"]} <= {r.category for r in rows.collect()}
    more = pipelines.additional_dataset(doc, rows.where("category = 'click'"))
    assert more.tiles.count() == doc.tiles.count() and {r.category for r in more.labels.collect()} == {"click"}


def test_given_areas_and_polygon_tiles(spark):
    rasters = T.rasters(spark, SF).withColumn("product", F.concat(F.lit("r"), F.col("raster_id")))
    doc = pipelines.labeled_dataset(rasters, T.labels(spark, SF), pipelines.Tiling(128, 0.25), features=T.features(spark, SF))
    assert doc.labels.count() > 0 and doc.tiles.select("file_name").distinct().count() == doc.tiles.count()
    own = pipelines.polygon_dataset(rasters, T.labels(spark, SF), 32, T.features(spark, SF), 0.8)
    assert own.tiles.count() == own.labels.count() > 0


def test_cloud_tiles(spark):
    clouds = spark.createDataFrame([(0, 0.0, 0.0, 1000.0, 900.0)], "cloud_id int, minx double, miny double, maxx double, maxy double")
    areas = spark.createDataFrame([("a", 0, 0, 500, 900), ("b", 500, 0, 1000, 900)], "aoi string, minx int, miny int, maxx int, maxy int").select("aoi", box("minx", "miny", "maxx", "maxy").alias("area"))
    points = T.cloud_points(spark, SF)
    got = pipelines.cloud_tiles(points, clouds, 250.0, areas=areas)
    assert {r.aoi for r in got.select("aoi").distinct().collect()} == {"a", "b"} and got.where("aoi = 'a' and x >= 500").count() == 0
    assert pipelines.cloud_tiles(points, clouds, 250.0, voxel=50.0).count() < got.count() + points.count()
    assert cloud.bounds(spark.createDataFrame([(0.0, 1.0, float("nan"), 2.0, None, None)], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")).first().min_y is None


def test_streamed_labels(spark, tmp_path):
    rows = T.labels(spark, SF).select("raster_id", "label_id", "shape").where("raster_id < 2")
    rows.write.parquet(str(tmp_path / "in"))
    schema = "raster_id long, label_id long, shape struct<minx:bigint,miny:bigint,maxx:bigint,maxy:bigint>"
    out = []
    tiles = T.tiles(spark, SF)
    q = arrivals.label_tiles(arrivals.arriving_labels(spark, str(tmp_path / "in"), schema), tiles, lambda df, n: out.append(df.count()), f"test-{tmp_path.name}")
    q.awaitTermination(120)
    from tessella.operators.labels import in_tile_pixels, tile_overlap

    assert sum(out) == in_tile_pixels(tile_overlap(tiles, rows)).count() > 0


def test_redistributed_areas_are_disjoint(spark):
    rows = [(1, "a", 0, 0, 10, 10), (1, "a", 5, 5, 12, 12), (1, "b", 8, 0, 20, 10), (2, "b", 0, 0, 4, 4), (2, "c", 0, 0, 8, 4)]
    df = spark.createDataFrame(rows, "raster_id long, aoi string, minx int, miny int, maxx int, maxy int").select("raster_id", "aoi", box("minx", "miny", "maxx", "maxy").alias("area"))
    areas = [aoi.Aoi("a", 0.75), aoi.Aoi("b", 0.25), aoi.Aoi("c", 0.0 + 1e-9, priority=True)]
    total = lambda rows, r, a: sum((x.area.maxx - x.area.minx) * (x.area.maxy - x.area.miny) for x in rows if (x.raster_id, x.aoi) == (r, a))
    got = aoi.redistributed(df, areas).collect()
    for x in got:
        for y in got:
            if x.raster_id == y.raster_id and x.aoi != y.aoi:
                assert min(x.area.maxx, y.area.maxx) <= max(x.area.minx, y.area.minx) or min(x.area.maxy, y.area.maxy) <= max(x.area.miny, y.area.miny)
    both = 2 * 10 + 2 * 5  # ground that both want on raster 1
    assert total(got, 1, "a") + total(got, 1, "b") == pytest.approx(100 + 49 - 25 + 120 - both)
    assert total(got, 2, "c") == 32 and total(got, 2, "b") == 0


def test_polygons_in_joins(spark):
    square = lambda x, y, s: [float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]
    triangle = [0.0, 0.0, 8.0, 0.0, 0.0, 8.0]
    labels_ = spark.createDataFrame([(1, 1, triangle), (1, 2, square(6, 6, 4))], "raster_id long, label_id long, flat array<double>")
    tiles = grid.tile_grid(spark.createDataFrame([(1, 16, 16)], "raster_id long, w int, h int"), 8)
    from tessella.operators import labels as L
    from tessella.operators import match

    got = {(r.label_id, r.tile_id): r.common_area for r in L.tile_overlap_polygons(tiles, labels_, 0.2).collect()}
    assert got == {(1, 0): 32.0, (2, 0): 4.0, (2, 1): 4.0, (2, 2): 4.0, (2, 3): 4.0}
    preds = spark.createDataFrame([(1, 0.9, triangle), (2, 0.8, square(0, 0, 5)), (3, 0.7, square(5, 5, 3))], "pred_id long, score double, flat array<double>")
    from tessella.functions import polygon as P

    boxed = preds.withColumn("shape", P.coco_bounds(F.array("flat")))
    assert {r.pred_id for r in nms.greedy_nms(boxed, 1, 2, flat="flat").collect()} == {1, 3}
    truth = preds.select(F.col("pred_id").alias("truth_id"), "flat")
    pairs = {(r.pred_id, r.truth_id) for r in match.polygon_matches(preds, truth, 0.5).collect()}
    assert pairs == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}
    points = spark.createDataFrame([(1, 2.5, 2.5), (2, 6.0, 6.0), (3, 1.0, 1.0)], "point_id long, x double, y double")
    near = {r.pred_id: r.point_id for r in match.polygon_point_matches(preds, points, 1.0).collect()}
    assert near == {1: 1, 2: 1, 3: 2}


def test_masks_and_cloud_items(spark):
    tiles = spark.createDataFrame([(0, 10, 10), (1, 10, 10)], "tile_idx long, width int, height int")
    own = spark.createDataFrame([(0, 2, [3, 4, 93], 5, 1, 1, 3, 3), (0, 1, None, None, 0, 0, 2, 2)], "tile_idx long, label_id long, runs array<bigint>, category_id long, minx int, miny int, maxx int, maxy int")
    own = own.withColumn("shape", box("minx", "miny", "maxx", "maxy"))
    (first, second) = datasets.instance_items(tiles, own).orderBy("tile_idx").collect()
    assert (first.masks, first.labels, first.areas, len(first.boxes)) == ([[3, 4, 93]], [0, 5], [4], 2) and second.boxes is None
    points = spark.createDataFrame([(7, 2, 1.0, 2.0, 3.0, 4.0), (7, 1, 0.0, 0.0, 0.0, None)], "tile_id long, point_id long, x double, y double, z double, semantic_label double")
    (item,) = datasets.cloud_items(points).collect()
    assert item.positions[1] == [1.0, 2.0, 3.0] and item.labels[1] == 4.0 and item.labels[0] != item.labels[0]


def test_coordinates(spark):
    from tessella.functions import affine as A
    from tessella.functions import polygon as P
    from tessella.operators import coords

    ring = P.ring_of_coco(F.array(*map(F.lit, (0.0, 0.0, 4.0, 0.0, 4.0, 2.0))))
    labels_ = spark.range(1).select(F.lit("a").alias("file_name"), F.lit(1).alias("raster_id"), F.array(F.array(ring)).alias("shape"))
    tiles = spark.range(1).select(F.lit("a").alias("file_name"), F.lit(1).alias("raster_id"), F.lit(10).alias("width"), F.lit(20).alias("height"), A.affine(0.5, 0, 500000, 0, -0.5, 5000000).alias("transform"))
    assert tuple(coords.extents(tiles).first().extent) == (500000, 4999990, 500005, 5000000)
    up = coords.to_coordinates(labels_, tiles)
    assert up.select(P.area(F.col("shape")).alias("a")).first().a == pytest.approx(1.0)
    back = coords.to_pixels(up, tiles).first().shape[0][0]
    assert [(round(p.x, 6), round(p.y, 6)) for p in back] == [(0, 0), (4, 0), (4, 2), (0, 0)]
    there = coords.reprojected(coords.reprojected(up, 32618, 4326), 4326, 32618).first().shape[0][0]
    assert there[1].x == pytest.approx(500002, abs=1e-4)


def test_overlapping_features_of_an_area_count_once(spark):
    r = random.Random(8)
    rows = [(0, "a", 0, 0, 50, 50), (0, "a", 0, 0, 50, 50)]  # a quarter of the label, twice
    for n in (1, 2, 6):
        for _ in range(n):
            x, y = r.randrange(-20, 90), r.randrange(-20, 90)
            rows.append((n, "ab"[r.randrange(2)], x, y, x + r.randrange(1, 80), y + r.randrange(1, 80)))
    own = spark.createDataFrame(rows, "raster_id int, aoi string, minx int, miny int, maxx int, maxy int").select("raster_id", "aoi", box("minx", "miny", "maxx", "maxy").alias("area"))
    whole = spark.createDataFrame([(i, i + 100) for i in (0, 1, 2, 6)], "raster_id int, label_id int")
    whole = whole.withColumn("shape", box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)))
    seen = {}
    for i, a, x0, y0, x1, y1 in rows:
        seen.setdefault((i, a), set()).update((x, y) for x in range(max(x0, 0), min(x1, 100)) for y in range(max(y0, 0), min(y1, 100)))
    seen = {k: len(v) for k, v in seen.items() if v}
    got = {(g.label_id - 100, g.aoi): g.ratio for g in aoi.covered_ratio(whole, own, 0.0).collect()}
    assert {k: round(v * 10_000) for k, v in got.items() if v} == seen and got[0, "a"] == 0.25
    assert aoi.covered_ratio(whole, own, 0.4).where("label_id = 100").count() == 0
    tiles = whole.select("raster_id", F.col("label_id").alias("tile_id"), F.col("shape").alias("tile"))
    assert {(g.raster_id, g.aoi): g.masked for g in aoi.masked_pixels(tiles, own).collect()} == {k: 10_000 - v for k, v in seen.items()}
