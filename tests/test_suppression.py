import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.box import box
from tessella.functions.kernels import intersection_area, ring_area
from tessella.functions.overlay import Region, intersection
from tessella.functions.slabs import pair_areas
from tessella.operators import aoi, match, nms
from tessella.plans import bindings as T

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "pred_id long, minx int, miny int, maxx int, maxy int, score double")
    return df.select("pred_id", "score", box("minx", "miny", "maxx", "maxy").alias("shape"))


def crowd(n, seed, size):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.randrange(size), r.randrange(size)
        rows.append((i, x, y, x + r.randrange(1, 25), y + r.randrange(1, 25), r.choice([None, 0.5, r.random(), r.random()])))
    return rows


def ranked(rows):
    return sorted(rows, key=lambda r: (-(r[5] if r[5] is not None else -1.0), r[0]))


def walk(rows, num, den):
    """Sequential greedy suppression of boxes."""
    kept = []
    for a in ranked(rows):
        for b in kept:
            c = max(min(a[3], b[3]) - max(a[1], b[1]), 0) * max(min(a[4], b[4]) - max(a[2], b[2]), 0)
            if c * den > num * ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - c):
                break
        else:
            kept.append(a)
    return {a[0] for a in kept}


def cut_walk(rows, threshold, keep_ratio):
    """Sequential cutting of boxes as sets of pixels."""
    live = {r[0]: {(x, y) for x in range(r[1], r[3]) for y in range(r[2], r[4])} for r in rows}
    order = [r[0] for r in ranked(rows)]
    for i, key in enumerate(order):
        for other in order[i + 1 :] if live[key] else ():
            if not (common := live[key] & live[other]):
                continue
            if len(common) / len(live[other]) > threshold:
                live[other] = set()
                continue
            rest, parts = live[other] - common, []
            left = set(rest)
            while left:
                front, part = [left.pop()], set()
                while front:
                    x, y = front.pop()
                    part.add((x, y))
                    near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
                    left -= near
                    front += near
                parts.append(part)
            best = max(parts, key=len, default=set())
            live[other] = rest if len(parts) < 2 else best if len(best) > keep_ratio * len(rest) else set()
    return {k: len(v) for k, v in live.items() if v}


@pytest.mark.parametrize("group_edges", [0, 10**6])
def test_greedy_walk_by_rounds_and_by_groups(spark, group_edges):
    rows = crowd(150, 4, 70)
    got = [r.pred_id for r in nms.greedy_nms(frame(spark, rows), 1, 5, cell=20.0, group_edges=group_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == walk(rows, 1, 5)


def test_greedy_walk_of_a_long_chain(spark):
    rows = [(i, 4 * i, 0, 4 * i + 10, 10, 0.5) for i in range(1000)]
    out = nms.greedy_nms(frame(spark, rows), 1, 4, cell=20.0)
    assert {r.pred_id for r in out.collect()} == walk(rows, 1, 4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


@pytest.mark.parametrize("group_edges,rivals", [(10**6, 256), (0, 2)])
def test_cutting_walk_by_rounds_and_by_groups(spark, monkeypatch, group_edges, rivals):
    monkeypatch.setattr(nms, "RIVALS", rivals)
    rows = crowd(40, 6, 60)
    out = nms.ioa_disambiguated(frame(spark, rows), 0.6, 0.5, cell=20.0, group_edges=group_edges).collect()
    assert {r.pred_id: r.area for r in out} == cut_walk(rows, 0.6, 0.5) and len(out) == len({r.pred_id for r in out})


def test_cutting_queries_match_the_sequential_walk(spark):
    from tessella.plans import catalogue

    rows = T.predictions(spark, SF).collect()
    want = {}
    for raster in {r.raster_id for r in rows}:
        want |= cut_walk([(r.pred_id, *r.shape, r.score) for r in rows if r.raster_id == raster], 0.5, 0.5)
    assert {r.pred_id: r.area for r in catalogue.nms_ioa_boxes(spark, SF).collect()} == want
    got = {r.pred_id: r.area for r in catalogue.nms_ioa_polygons(spark, SF).collect()}
    assert {k: pytest.approx(v, abs=1e-3) for k, v in got.items()} == want


def test_polygons_with_holes_are_cut(spark):
    square = lambda x, y, s: [float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]
    df = spark.createDataFrame([(1, 0.9, square(4, 4, 2)), (2, 0.8, square(0, 0, 10)), (3, 0.7, square(20, 0, 3))], "pred_id long, score double, flat array<double>")
    from tessella.functions import polygon as P

    df = df.withColumn("shape", P.coco_bounds(F.array("flat")))
    for most in (0, 100):
        got = {r.pred_id: (round(r.area, 6), len(r.pieces)) for r in nms.ioa_disambiguated(df, flat="flat", group_edges=most).collect()}
        assert got == {1: (4, 1), 2: (96, 2), 3: (9, 1)}


def star(r, x, y, n):
    a = (np.arange(n) + r.uniform(0, 0.4, n)) * 2 * np.pi / n
    d = r.uniform(2, 9, n)
    return np.stack([x + d * np.cos(a), y + d * np.sin(a)], axis=1)


def test_common_area_of_general_polygons():
    r = np.random.default_rng(0)
    for k in range(120):
        a, b = star(r, 10, 10, 3 + k % 9), star(r, 12, 9, 3 + k % 7)
        assert intersection_area(a, b) == pytest.approx(Region(intersection([a], [b])).area, abs=1e-5)
        assert intersection_area(a, b[::-1]) == pytest.approx(intersection_area(b, a), abs=1e-9)
    ell = np.array([(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)], float)
    pixels = lambda p: {(x, y) for x in range(12) for y in range(12) if inside(p, x + 0.5, y + 0.5)}

    def inside(p, x, y):
        hit = False
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
        return hit

    for dx, dy in ((1, 1), (2, 0), (-1, 3), (4, 4)):
        assert intersection_area(ell, ell + (dx, dy)) == pytest.approx(len(pixels(ell) & pixels(ell + (dx, dy))))


def test_a_ratio_on_the_threshold_is_not_over_it(spark):
    rows = [(k, [float(v) for v in (x, y, x + 8, y, x + 8, y + w, x, y + w)]) for k, (x, y, w) in enumerate([(i * 37 % 601, i * 53 % 401, 3 + i % 29) for i in range(200)])]
    preds = spark.createDataFrame(rows, "pred_id long, flat array<double>")
    # the truth lies inside with three fifths of the ground: IoU is 0.6 and not over it
    truth = spark.createDataFrame([(k, [f[0], f[1], f[2], f[3], f[4], f[1] + (f[5] - f[1]) * 0.6, f[6], f[1] + (f[5] - f[1]) * 0.6]) for k, f in rows], "truth_id long, flat array<double>")
    same = match.polygon_matches(preds, truth, 0.6).where("pred_id = truth_id")
    assert same.count() == 0 and match.polygon_matches(preds, truth, 0.5999).where("pred_id = truth_id").count() == 200


def test_walks_are_dealt_by_the_number_of_conflicts(spark):
    edges = spark.range(3000).selectExpr("id % 700 as scope", "cast(0 as long) as component", "id as hi", "id + 1 as lo")
    few, many = nms._dealt(edges, 3000), nms._dealt(edges, 40 * nms.TASK_EDGES)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 41
    assert many.withColumn("task", F.spark_partition_id()).groupBy("scope").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0


def test_boxes_are_matched_without_python(spark):
    box = lambda x, y, w, h: [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]
    boxes = [(k, box(k * 37 % 60, k * 53 % 40, 8 + k % 41, 8 + k % 29)) for k in range(120)]
    mixed = [*boxes, (200, [0.0, 0.0, 8.0, 0.0, 0.0, 8.0]), (201, [1.0, 1.0, 30.0, 2.0, 29.0, 25.0, 0.0, 24.0]), (202, None), (203, [])]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} long, flat array<double>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plain = match.polygon_matches(table(boxes, "pred_id"), table(boxes, "truth_id"), 0.6)
    assert not any(x in plan(plain) for x in ("Python", "Arrow"))
    got = {(r.pred_id, r.truth_id): r.iou for r in match.polygon_matches(table(mixed, "pred_id"), table(mixed, "truth_id"), 0.6).collect()}
    want = {}
    for i, a in mixed:
        for k, b in mixed:
            if a and b and (common := pair_areas([[np.array(a)]], [[np.array(b)]])[0]):
                area = [pair_areas([[np.array(x)]], [[np.array(x)]])[0] for x in (a, b)]
                if (iou := common / (sum(area) - common)) > 0.6 + 1e-9:
                    want[i, k] = pytest.approx(iou)
    assert got == want and (201, 201) in got and (200, 200) in got


def test_corner_areas_match_a_plain_walk(spark):
    tiles = [(r.raster_id, r.tile_id, r.row // T.STEP, r.col // T.STEP) for r in T.tiles(spark, SF).collect()]
    areas = [aoi.Aoi("a", 0.5, 1), aoi.Aoi("b", 0.3, 2), aoi.Aoi("c", 0.2, 3)]
    want = set()
    for raster in {t[0] for t in tiles}:
        own = [t for t in tiles if t[0] == raster]
        n, rows, cols = len(own), max(t[2] for t in own), max(t[3] for t in own)
        exact = {a.name: a.percentage * n for a in areas}
        quota = {k: int(v + 1e-9) for k, v in exact.items()}
        for k in sorted(exact, key=lambda k: -(exact[k] - quota[k]))[: n - sum(quota.values())]:
            quota[k] += 1
        for place, a in enumerate(areas):
            at = {t: (rows - t[2] if place >= 2 else t[2], cols - t[3] if place % 2 else t[3]) for t in own}
            chosen = sorted(own, key=lambda t: (max(at[t]), at[t][0] <= at[t][1], min(at[t]), t[1]))[: quota[a.name]]
            want |= {(raster, t[1], a.name) for t in chosen}
            own = [t for t in own if t not in chosen]
    got = aoi.corner(T.tiles(spark, SF), areas, T.STEP).collect()
    assert {(r.raster_id, r.tile_id, r.aoi) for r in got} == want and len(got) == len(want)


def test_redistributed_ground_matches_pixels(spark):
    """Each pixel column strip of two areas goes to one of them in the ratio of their shares."""
    rows = [(1, "a", 0, 0, 20, 10), (1, "b", 10, 0, 40, 10), (1, "c", 30, 5, 50, 10)]
    df = spark.createDataFrame(rows, "raster_id long, aoi string, minx int, miny int, maxx int, maxy int").select("raster_id", "aoi", box("minx", "miny", "maxx", "maxy").alias("area"))
    out = aoi.redistributed(df, [aoi.Aoi("a", 0.4), aoi.Aoi("b", 0.4), aoi.Aoi("c", 0.2)]).collect()
    total = {k: sum((r.area.maxx - r.area.minx) * (r.area.maxy - r.area.miny) for r in out if r.aoi == k) for k in "abc"}
    assert total["a"] == pytest.approx(200 - 50) and sum(total.values()) == pytest.approx(200 + 300 + 100 - 100 - 50)
    # b and c share 50: two thirds go to b, one third to c
    assert total["c"] == pytest.approx(100 - 50 * 2 / 3) and total["b"] == pytest.approx(300 - 50 - 50 / 3)


def test_a_raster_of_stacked_boxes_is_one_group_of_cutting(spark, monkeypatch):
    # 100 boxes in one place are 4,950 pairs: one walk, where rounds of jobs took one round for each kept box
    rows = spark.range(100).select(F.col("id").alias("pred_id"), F.lit(1).alias("r"), (F.col("id") / 100).alias("score"), box(F.col("id") % 7, F.col("id") % 5, F.col("id") % 7 + 20, F.col("id") % 5 + 20).alias("shape"))
    want = sorted(r[:2] for r in nms.ioa_disambiguated(rows, scope="r", group_edges=10_000).select("pred_id", "area").collect())
    monkeypatch.setattr(nms, "RIVALS", None)  # rounds can't run
    assert sorted(r[:2] for r in nms.ioa_disambiguated(rows, scope="r").select("pred_id", "area").collect()) == want


def test_few_shapes_of_a_scope_are_walked_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(nms, "self_pairs", lambda *_, **__: pytest.fail("shapes of a small scope were joined"))
    r, rows = random.Random(8), []
    for i in range(300):
        x, y, w, h = (r.randrange(a, b) for a, b in ((-20, 20), (-20, 20), (2, 30), (2, 30)))
        ell = [float(v) for v in (x, y, x + w, y, x + w, y + h // 2, x + w // 2, y + h // 2, x + w // 2, y + h, x, y + h)]
        star = [float(v) for v in (x, y, x + w, y, x + w / 2, y + h)]
        rows.append((i, None if i % 60 == 0 else i % 6, (x, y, x + w, y + h), r.choice([None, float("nan"), *(k / 4 for k in range(9))]), r.choice([ell, star, None])))
    df = spark.createDataFrame(rows, "pred_id long, raster int, shape struct<minx:long,miny:long,maxx:long,maxy:long>, score double, flat array<double>")
    for flat in (None, "flat"):
        kept = []
        for i, raster, b, score, poly in sorted(rows, key=lambda q: (q[3] is None, q[3] is not None and q[3] == q[3], -q[3] if q[3] is not None and q[3] == q[3] else 0, q[0])):
            mine = [b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3]] if flat is None else poly
            if raster is None or mine is None or not any(k[1] == raster and over(k[2], mine, 3, 10) for k in kept):
                kept.append((i, raster, mine))
        assert {x.pred_id for x in nms.greedy_nms(df, 3, 10, "raster", flat=flat).collect()} == {k[0] for k in kept}


def over(a, b, num, den):
    """The IoU of two polygons, by the slabs, is over num/den."""
    if a is None or b is None:
        return False
    a, b = (np.array(p, float).reshape(-1, 2) for p in (a, b))
    common = pair_areas([[a]], [[b]])[0]
    return common * den > (abs(ring_area(a)) + abs(ring_area(b)) - common) * (num + 1e-9 * den)


def test_few_polygons_of_a_scope_are_matched_without_a_join(spark, monkeypatch):
    r, sides = random.Random(11), []
    for key in ("pred_id", "truth_id"):
        rows = []
        for i in range(80):
            x, y, w, h = (r.randrange(a, b) for a, b in ((0, 12), (0, 12), (6, 20), (6, 20)))
            ell = [x, y, x + w, y, x + w, y + h // 2, x + w // 2, y + h // 2, x + w // 2, y + h, x, y + h]
            rows.append((i, None if i == 7 else i % 4, r.choice([ell, [x, y, x + w, y, x + w, y + h, x, y + h], [x, y, x + w, y, x + w / 2, y + h]]) if i % 20 else None))
        sides.append(spark.createDataFrame([(i, s, f and [float(v) for v in f]) for i, s, f in rows], f"{key} long, raster int, flat array<double>"))
    found = []
    for few in (512, 35, 0):  # all scopes, some, none
        monkeypatch.setattr(match, "FEW", few)
        got = match.polygon_matches(sides[0].where("raster > 1 or pred_id < 40"), sides[1], 0.4, "raster")
        found.append({(x.pred_id, x.truth_id): x.iou for x in got.collect()})
    assert len(found[0]) > 50 and found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2])
    monkeypatch.setattr(match, "FEW", 512)
    monkeypatch.setattr(match, "cell_join", lambda *_: pytest.fail("polygons of a small scope were joined"))
    assert match.polygon_matches(*sides, 0.4, "raster").count() >= len(found[0])


def test_few_polygons_of_a_scope_are_cut_without_a_join(spark, monkeypatch):
    r, rows = random.Random(21), []
    for i in range(70):
        x, y, w, h = (r.randrange(a, b) for a, b in ((0, 30), (0, 30), (4, 26), (4, 26)))
        shape = r.choice([[x, y, x + w, y, x + w, y + h, x, y + h], [x, y, x, y + h, x + w, y + h, x + w, y], [x, y, x + w, y + h / 3, x + w / 2, y + h], [x, y, x + w, y, x + w, y + h // 2, x + w // 2, y + h // 2, x + w // 2, y + h, x, y + h]])
        rows.append((i, None if i % 35 == 0 else i % 3, (x, y, x + w, y + h), r.choice([None, 0.5, r.random()]), [float(v) for v in shape]))
    df = spark.createDataFrame(rows, "pred_id long, raster int, shape struct<minx:long,miny:long,maxx:long,maxy:long>, score double, flat array<double>")
    got = lambda: {x.pred_id: x.area for x in nms.ioa_disambiguated(df, 0.5, 0.5, "raster", flat="flat").collect()}
    with monkeypatch.context() as m:
        m.setattr(nms, "_few", lambda rows, most: (None, rows))
        by_pairs = got()
    monkeypatch.setattr(nms, "self_pairs", lambda *_, **__: pytest.fail("polygons of a small scope were joined"))
    assert 10 < len(by_pairs) < 70 and got() == pytest.approx(by_pairs, rel=1e-6)
