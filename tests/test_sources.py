import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import polygon as P
from tessella.functions import rle as R
from tessella.functions.box import box
from tessella.sources import coco_files, files, tiff, vector


def read_text(path):
    assert path.is_file()
    return path.read_text()


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0, 5], [2, 0, 5], [2, 2, 5], [0, 0, 5]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"name": "b", "n": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc))
    got = vector.read_geojson(spark, str(tmp_path / "in.geojson"), ["name"])
    rows = {r.feature_id: r for r in got.collect()}
    assert [len(rows[i].shape or []) for i in range(3)] == [1, 2, 0] and rows[1].attrs["n"] == "2"
    assert [r.a for r in got.orderBy("feature_id").select(P.area(F.col("shape")).alias("a")).collect()] == [2.0, 4.0, None]
    with pytest.raises(Exception, match="no property"):
        vector.read_geojson(spark, str(tmp_path / "in.geojson"), ["n"]).collect()
    vector.write_geojson(got.where("shape is not null").select("feature_id", "shape"), str(tmp_path / "out"))
    again = json.loads(read_text(tmp_path / "out"))
    assert [f["properties"]["feature_id"] for f in again["features"]] == [0, 1]
    vector.write_geojson(got.where("false").select("feature_id", "shape"), str(tmp_path / "none"))
    assert json.loads(read_text(tmp_path / "none"))["features"] == []


def test_voc_and_csv(spark, tmp_path):
    one = "<object><name>oak</name><bndbox><xmin>1</xmin><ymin>2.7</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation>{one}</annotation>")
    (tmp_path / "b.xml").write_text(f"<annotation>{one}{one}</annotation>")
    got = vector.read_voc(spark, str(tmp_path / "*.xml")).collect()
    assert len(got) == 3 and got[0].shape_box.asDict() == {"minx": 1, "miny": 2, "maxx": 3, "maxy": 4} and got[0].category == "oak"
    with pytest.raises(Exception, match="no kind"):
        vector.read_voc(spark, str(tmp_path / "a.xml"), "kind").collect()
    (tmp_path / "x.csv").write_text("img_name,Xmin,Ymin,Xmax,Ymax,k\na,1,2,3,4,p\nb,5,6,7,8,q\n")
    (row,) = vector.read_boxes_csv(spark, str(tmp_path / "x.csv"), "b", category="k").collect()
    assert (row.shape_box.minx, row.category) == (5.0, "q")


def test_gpkg_round_trip(spark, tmp_path):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 3), (0, 0))]
    raw = vector.gpkg_bytes([{"shape": [[ring]], "name": "a"}, {"shape": [[ring], [ring]], "name": None}], ["name"], 32618)
    (tmp_path / "a.gpkg").write_bytes(raw)
    got = vector.read_gpkg(spark, str(tmp_path / "a.gpkg")).orderBy("feature_id").collect()
    assert [len(r.shape) for r in got] == [1, 2] and got[0].attrs["name"] == "a" and "name" not in got[1].attrs and got[0].srid == 32618
    assert got[0].shape[0][0][1].asDict() == {"x": 4.0, "y": 0.0}


def test_coco_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, 10, 20, "a.tif"), (2, 10, 20, "b.tif")], "id long, width int, height int, file_name string")
    anns = spark.createDataFrame([(1, [[0.0, 0.0, 4.0, 0.0, 4.0, 2.0]], False, 4.0, 0, 1, [0.0, 0.0, 4.0, 2.0], 1, 0.5, {"k": "v"}), (2, [[1.0, 1.0, 2.0, 1.0, 2.0, 3.0]], False, 1.0, 0, 2, None, -1, None, {})],
        "id long, segmentation array<array<double>>, is_rle_format boolean, area double, iscrowd int, image_id long, bbox array<double>, category_id long, score double, other_attributes map<string,string>")
    cats = spark.createDataFrame([(1, "oak", "")], "id long, name string, supercategory string")
    coco_files.check_document(images, anns, cats)
    for fold in ("train", "valid"):
        coco_files.write_coco(images, anns, cats, str(tmp_path / f"p_coco_sf1p0_{fold}.json"))
    doc = json.loads(read_text(tmp_path / "p_coco_sf1p0_train.json"))
    assert [len(doc[k]) for k in ("images", "annotations", "categories")] == [2, 2, 1] and "score" not in doc["annotations"][1]
    flat = tmp_path / "flat"
    flat.mkdir()
    for fold in ("train", "valid"):
        (flat / f"p_coco_sf1p0_{fold}.json").write_text(json.dumps(doc))
    (flat / "other.json").write_text("{}")
    i, a, c = coco_files.read_coco(spark, str(flat), "valid", recursive=True)
    assert (i.count(), a.count(), c.count()) == (2, 2, 1)
    boxes = {r.id: r.box_of.asDict() for r in coco_files.annotation_box(a).collect()}
    assert boxes == {1: {"minx": 0, "miny": 0, "maxx": 4, "maxy": 2}, 2: {"minx": 1, "miny": 1, "maxx": 2, "maxy": 3}}
    assert [r.n for r in coco_files.segmentation_shape(a).select(F.size("shape").alias("n")).collect()] == [1, 1]
    coco_files.write_coco(images.where("false"), anns.where("false"), cats.where("false"), str(tmp_path / "none"))
    assert json.loads(read_text(tmp_path / "none"))["annotations"] == []
    with pytest.raises(ValueError, match="no image"):
        coco_files.check_document(images.where("id = 1"), anns, cats)


def test_runs_match_masks(spark):
    boxes = [(2, 3, 7, 6), (0, 0, 10, 8), (0, 0, 4, 8), (9, 7, 10, 8), (3, 0, 5, 8), (5, 5, 5, 7), (-3, -2, 4, 30)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "id int, minx int, miny int, maxx int, maxy int")
    runs = df.select("id", R.box_runs(box("minx", "miny", "maxx", "maxy"), 10, 8).alias("runs"))
    out = runs.select("id", "runs", R.decoded(R.encoded("runs")).alias("again"), R.area("runs").alias("area"), R.bounds("runs", 8).alias("b"))
    for r in out.collect():
        x0, y0, x1, y1 = boxes[r.id]
        mask = np.zeros((8, 10), bool)
        mask[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)] = True
        flat = mask.T.ravel()
        got = np.concatenate([np.full(n, k % 2 == 1) for k, n in enumerate(r.runs)])
        assert (got == flat).all() and r.again == r.runs and r.area == mask.sum()
        if mask.any():
            ys, xs = np.nonzero(mask)
            assert tuple(r.b) == (xs.min(), ys.min(), xs.max(), ys.max())
        else:
            assert r.b is None


def test_rasters_and_las(spark, tmp_path):
    image = np.arange(5 * 7).reshape(5, 7).astype("uint8")
    np.save(tmp_path / "r.npy", image)
    blocks = files.read_raster_blocks(spark, str(tmp_path / "r.npy"), 4).collect()
    assert len(blocks) == 4
    b = next(b for b in blocks if (b.block_row, b.block_col) == (1, 1))
    assert b.pixels[:4] == [32.0, 33.0, 34.0, 0.0] and sum(b.pixels) == 99
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", b"\x01\x02"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 2)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.25, 100, 200, 0)
    rows = b"".join(struct.pack("<3iHBBBBH", x, 2 * x, 4 * x, 7, 0, 5, 0, 0, 0) for x in (1, 2))
    (tmp_path / "c.las").write_bytes(bytes(head) + rows)
    got = files.read_las(spark, str(tmp_path / "c.las")).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.classification) for r in got] == [(100.5, 201.0, 1.0, 5), (101.0, 202.0, 2.0, 5)]
    with pytest.raises(ValueError, match="not a LAS"):
        files.las_points(b"PK")


def test_tiles_and_point_csv(spark, tmp_path):
    for fold in ("train", "valid"):
        (tmp_path / "tiles" / fold).mkdir(parents=True)
        (tmp_path / "tiles" / fold / f"p_tile_{fold}_sf1p0_0_96_128_128_7.tif").write_bytes(b"x")
    got = files.tiles_of_names(files.find_tiles(spark, str(tmp_path), fold="valid")).collect()
    assert [(r.aoi, r.row, r.tile_id, r.scale_factor) for r in got] == [("valid", 96, 7, 1.0)]
    (tmp_path / "tiles" / "train" / "p_tile_valid_sf1p0_0_96_128_128_7.tif").write_bytes(b"x")
    with pytest.raises(ValueError, match="more than once"):
        files.find_tiles(spark, str(tmp_path))
    tiles = spark.createDataFrame([("a_train_1", 0.0, 1.0, 0.0, 1.0, "EPSG:32618"), ("a_test_2", 0.0, 1.0, 0.0, 1.0, None)], "tile_name string, min_x double, max_x double, min_y double, max_y double, crs string")
    files.write_point_tiles_csv(tiles, str(tmp_path / "csv"))
    assert files.read_point_tiles_csv(spark, str(tmp_path / "csv"), "train").count() == 1


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "float32"])
def test_tiff_round_trip(compress, kind):
    data = np.random.default_rng(0).integers(0, 200, (3, 11, 7)).astype(kind)
    raw = tiff.tiff_bytes(data, (0.5, 0, 10, 0, -0.5, 20), 32618, compress)
    got, transform, epsg = tiff.read_tiff(raw)
    assert got.dtype == data.dtype and (got == data).all() and transform == (0.5, 0, 10, 0, -0.5, 20) and epsg == 32618
    assert tiff.read_tiff(tiff.tiff_bytes(data))[1:] == (None, None)


def test_tiff_frames(spark, tmp_path):
    data = np.arange(2 * 6 * 8).reshape(2, 6, 8).astype("uint8")
    (tmp_path / "a.tif").write_bytes(tiff.tiff_bytes(data, (1.0, 0, 0, 0, -1.0, 6), 32618))
    path = str(tmp_path / "a.tif")
    assert tiff.exists(spark, path) and not tiff.exists(spark, str(tmp_path / "b.tif"))
    got = tiff.read_tiff_blocks(spark, path, 4).where("band = 1 and block_row = 1 and block_col = 0").first()
    assert got.pixels[:8] == [80, 81, 82, 83, 88, 89, 90, 91] and sum(got.pixels[8:]) == 0
    half = tiff.read_tiff_blocks(spark, path, 4, scale_factor=0.5).where("band = 0").first()
    assert (half.width, half.height, half.transform[0]) == (4, 3, 2.0) and half.pixels[0] == round((0 + 1 + 8 + 9) / 4)
    assert tiff.read_tiff_blocks(spark, path, 4, ground_resolution=2.0).first().width == 4
    with pytest.raises(ValueError, match="not both"):
        tiff.read_tiff_blocks(spark, path, 4, 0.5, 2.0)
    with pytest.raises(ValueError, match="not a"):
        tiff.read_tiff(b"II+\0xxxx")
    tiles = spark.createDataFrame([("t.tif", [[1, 2, 3, 4, 5, 6]], 2, 3, None, None)], "file_name string, bands array<array<int>>, height int, width int, transform array<double>, epsg int")
    (row,) = tiff.encoded_tiles(tiles).collect()
    assert tiff.read_tiff(bytes(row.content))[0].tolist() == [[[1, 2, 3], [4, 5, 6]]]


def test_predictions_of_files_become_one_set(spark, tmp_path):
    square = lambda x, y, s: [[float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]]
    runs = spark.range(1).select(R.encoded(R.box_runs(box(*map(F.lit, (40, 40, 60, 60))), 100, 100)).alias("t")).first().t
    for name, rows in (("a", [(1, square(10, 10, 20), 0.9), (2, square(11, 10, 20), 0.8), (3, square(0, 0, 20), 0.99)]), ("b", [(1, square(40, 40, 20), 0.7), (2, {"counts": runs, "size": [100, 100]}, 0.6), (3, square(70, 70, 10), 0.05)])):
        doc = {"images": [{"id": 1, "width": 100, "height": 100, "file_name": f"{name}.tif"}], "categories": [{"id": 1, "name": "oak", "supercategory": ""}],
               "annotations": [{"id": i, "image_id": 1, "category_id": 1, "segmentation": s, "is_rle_format": isinstance(s, dict), "area": 1.0, "iscrowd": 0, "score": v, "other_attributes": {"k": "v"}} for i, s, v in rows]}
        (tmp_path / f"p_coco_sf1p0_{name}.json").write_text(json.dumps(doc))
    from tessella.functions import affine as A
    from tessella.plans import pipelines

    tiles = spark.createDataFrame([("a.tif", 0.0), ("b.tif", 1000.0)], "file_name string, x double").select("file_name", F.lit(100).alias("width"), F.lit(100).alias("height"), A.affine(1, 0, F.col("x"), 0, -1, 500).alias("transform"))
    rows = pipelines.coco_to_shapes(spark, str(tmp_path), tiles, ["k"]).collect()
    assert len(rows) == 6 and {r.category_name for r in rows} == {"oak"} and {r.attr_k for r in rows} == {"v"}
    got = pipelines.aggregate_coco(spark, str(tmp_path), tiles).collect()
    assert sorted((r.file_name, r.id) for r in got) == [("a.tif", 1), ("b.tif", 1)]
    cut = pipelines.aggregate_coco(spark, str(tmp_path), tiles, disambiguate=0.99).collect()
    assert sorted((r.file_name, r.id, round(r.area)) for r in cut)[:2] == [("a.tif", 1, 400), ("a.tif", 2, 20)]


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_documents_are_single_files(spark, tmp_path, monkeypatch, chunk):
    import json

    monkeypatch.setattr(vector, "CHUNK_BYTES", chunk)
    images = spark.range(40).selectExpr("id", "concat('tile ü', id) as file_name", "10 as width").repartition(5)
    anns = spark.range(300).selectExpr("id", "id % 40 as image_id", "id % 3 as category_id", "if(id % 2 = 0, 0.5D, null) as score").repartition(7)
    cats = spark.range(3).selectExpr("id", "concat('c', id) as name")
    for name, some in (("whole", anns), ("none", anns.where("false"))):
        path = tmp_path / "deep" / f"{name}.json"
        for _ in range(2):  # written over
            coco_files.write_coco(images, some, cats, str(path), "a description")
        found = json.loads(path.read_text())
        assert [x["id"] for x in found["images"]] == list(range(40)) and found["images"][7]["file_name"] == "tile ü7"
        assert [x["id"] for x in found["annotations"]] == list(range(300 if name == "whole" else 0)) and len(found["categories"]) == 3
    coco_files.write_coco(images.where("false"), anns.where("false"), cats.where("false"), str(tmp_path / "empty.json"))
    assert json.loads((tmp_path / "empty.json").read_text())["annotations"] == []
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["none.json", "whole.json"]
