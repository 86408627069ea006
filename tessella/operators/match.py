"""Matching predictions with ground truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import polygon as P
from tessella.functions.batch import Polygons, meeting
from tessella.functions.kernels import polygon_intersection_area
from tessella.operators.spatial import cell_join, contained_points
from tessella.session import spread, written

FEW, BATCH_ROWS = 512, 4_096  # polygons of a scope that is matched as a whole; rows of scopes for one call of Python


def iou_matches(preds: DataFrame, truth: DataFrame, num: int, den: int, scope: str | None = None, cell: float = 64.0) -> DataFrame:
    """``(pred_id, truth_id, shape, iou, ...)``: all pairs of IoU over num/den, with the truth's other columns.

    The prediction's shape stays, the truth's goes; a row may match several of the other side.
    """
    other = truth.withColumnRenamed("shape", "truth_shape").withColumnsRenamed({c: f"truth_{c}" for c in truth.columns if c not in ("truth_id", "shape")})
    pairs = cell_join(preds, other, "shape", "truth_shape", [(scope, f"truth_{scope}")] if scope else None, cell)
    a, b = F.col("shape"), F.col("truth_shape")
    common = B.intersection_area(a, b)
    kept = pairs.where(common * den > (B.area(a) + B.area(b) - common) * num)
    return kept.withColumn("iou", B.iou(a, b)).drop("truth_shape")


def _nearest(pairs: DataFrame, key: str, distance: Column, least: float) -> DataFrame:
    best = F.min(F.struct(distance.alias("d"), "point_id"))
    found = pairs.groupBy(key).agg(best.alias("best")).select(key, "best.point_id", F.col("best.d").alias("distance"))
    return found.where(F.col("distance") < least)


def point_matches(preds: DataFrame, points: DataFrame, most: float, scope: str | None = None, cell: float = 64.0, require: bool = False) -> DataFrame:
    """``(pred_id, point_id, distance)``: for each box the inner point nearest its centroid, relative to the
    centroid's distance from the border; under ``most`` only. ``require``: an error if nothing matches."""
    own = points.withColumnsRenamed({c: f"point_{c}" for c in points.columns if c not in ("point_id", "x", "y")})
    pairs = contained_points(own, preds.select("pred_id", "shape", *([scope] if scope else [])), "x", "y", "shape", [(f"point_{scope}", scope)] if scope else None, cell)
    cx, cy = B.centroid(F.col("shape"))
    far = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    out = _nearest(pairs, "pred_id", F.try_divide(far, B.exterior_distance(F.col("shape"))), most)
    if require and out.isEmpty():
        raise ValueError("no prediction matches a point")
    return out


def polygon_matches(preds: DataFrame, truth: DataFrame, threshold: float, scope: str | None = None, cell: float = 64.0) -> DataFrame:
    """``(pred_id, truth_id, iou)`` of polygons ``flat`` whose IoU is over ``threshold``; boxes only choose the candidates.

    Areas of general polygons are rounded, so an IoU counts as over only by more than 1e-9. Scopes of up to FEW polygons of both
    sides are matched as whole groups of a batch, so pairs are never rows of a join; larger ones, and a table without scopes, by cells.
    """
    if scope is None:
        return _matched_by_cells(preds, truth, threshold, None, cell)
    sides = [x.select(F.lit(k).alias("side"), *[(F.col(c) if i == k else F.lit(None).cast(y.schema[c].dataType)).alias(c) for i, (y, c) in enumerate(((preds, "pred_id"), (truth, "truth_id")))], F.col(scope).alias("scope"), F.col("flat").cast("array<double>").alias("flat")) for k, x in enumerate((preds, truth))]
    rows = sides[0].unionByName(sides[1]).where("scope is not null")
    counts = written(rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("sides")), "scopes")
    small = F.col("n") <= FEW
    n_small = counts.agg(F.sum(F.when(small & (F.col("sides") == 2), F.col("n")))).first()[0] or 0
    large = counts.where(~small).select("scope")
    all_few = large.isEmpty()
    few = (rows if all_few else rows.join(large, "scope", "left_anti")).groupBy(F.pmod(F.xxhash64("scope"), F.lit(n_small // BATCH_ROWS + 1)))
    kinds = [f"{c} {x.schema[c].dataType.simpleString()}" for x, c in ((preds, "pred_id"), (truth, "truth_id"))]
    out = few.applyInArrow(lambda t: _matched(t, threshold), f"{', '.join(kinds)}, iou double")
    if all_few:
        return out
    many = [x.join(large.withColumnRenamed("scope", "large_scope"), F.col(scope) == F.col("large_scope"), "left_semi") for x in (preds, truth)]
    return out.unionByName(_matched_by_cells(*many, threshold, scope, cell))


def _matched(rows: pa.Table, threshold: float) -> pa.Table:
    """Matches of a batch of whole scopes."""
    rows = rows.combine_chunks()
    scopes = rows["scope"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, side = int(scopes.max()) + 1, rows["side"].to_numpy()
    polygons, sizes, ids = [], [], []
    for k, key in enumerate(("pred_id", "truth_id")):
        at = np.flatnonzero(side == k)
        at = at[np.argsort(scopes[at], kind="stable")]
        polygons.append(Polygons(rows["flat"].take(pa.array(at)).combine_chunks()))
        sizes.append(np.bincount(scopes[at], minlength=n))
        ids.append(rows[key].take(pa.array(at)))
    (a, b), starts, found = polygons, [np.cumsum(s) - s for s in sizes], []
    for i, j in meeting(a, starts[0], sizes[0], b, starts[1], sizes[1]):
        whole = a.area[i] + b.area[j]
        # no more can be common than the bounds' common ground and the smaller area
        most = np.minimum(np.minimum(a.most(i, b, j), a.area[i]), b.area[j])
        some = most > threshold * (whole - most)
        i, j, whole = i[some], j[some], whole[some]
        common = a.common(i, b, j)
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = common / (whole - common)
        over = iou > threshold + 1e-9
        found.append((i[over], j[over], iou[over]))
    i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"pred_id": ids[0].take(pa.array(i)), "truth_id": ids[1].take(pa.array(j)), "iou": iou})


def _matched_by_cells(preds: DataFrame, truth: DataFrame, threshold: float, scope: str | None, cell: float) -> DataFrame:
    """``polygon_matches`` by a join of cells."""
    within = lambda side: [F.col(scope).alias(f"scope_{side}")] if scope else []
    # written first, so that coordinates are made once and not for each use of one
    preds, truth = (written(spread(x.select(k, "flat", *([scope] if scope else []))), "flats") for x, k in ((preds, "pred_id"), (truth, "truth_id")))
    left = preds.select("pred_id", F.col("flat").alias("flat_a"), P.flat_bounds(F.col("flat")).alias("box_a"), P.flat_area(F.col("flat")).alias("area_a"), *within("a"))
    right = truth.select("truth_id", F.col("flat").alias("flat_b"), P.flat_bounds(F.col("flat")).alias("box_b"), P.flat_area(F.col("flat")).alias("area_b"), *within("b"))
    # a polygon of four corners as large as its bounding box is that box: only others go to Python
    plain = lambda k: ((F.size(f"flat_{k}") == 8) & (F.col(f"area_{k}") == B.area(F.col(f"box_{k}")))).alias(f"plain_{k}")
    # written, so that bounds and areas are made once for a polygon and not for every cell and pair
    left, right = written(left.select("*", plain("a")), "left_polygons"), written(right.select("*", plain("b")), "right_polygons")
    over = lambda common: F.try_divide(common, F.col("area_a") + F.col("area_b") - common)
    on, least = [("scope_a", "scope_b")] if scope else None, threshold + 1e-9
    (boxes_a, other_a), (boxes_b, other_b) = ((x.where(f"plain_{k}"), x.where(f"not coalesce(plain_{k}, false)")) for x, k in ((left, "a"), (right, "b")))

    def shared(x: Column, y: Column) -> Column:
        return (F.least(x["maxx"], y["maxx"]) - F.greatest(x["minx"], y["minx"])) * (F.least(x["maxy"], y["maxy"]) - F.greatest(x["miny"], y["miny"]))

    def alike(x: Column, y: Column) -> Column:
        """The IoU of boxes is over. The common ground stands here once: a longer condition makes a method too large to be compiled."""
        return B.overlaps(x, y) & (shared(x, y) * (1 + least) > (F.col("area_a") + F.col("area_b")) * least)

    # boxes meet boxes without their coordinates and without Python
    pairs = cell_join(boxes_a.drop("flat_a", "plain_a"), boxes_b.drop("flat_b", "plain_b"), "box_a", "box_b", on, cell, alike)
    out = pairs.select("pred_id", "truth_id", over(shared(F.col("box_a"), F.col("box_b"))).alias("iou"))
    for a, b in ((other_a, right), (boxes_a, other_b)):
        if a.isEmpty() or b.isEmpty():
            continue
        pairs = cell_join(a, b, "box_a", "box_b", on, cell)
        # no more can be common than the boxes' common ground and the smaller area; few pairs need the exact one
        pairs = pairs.where(over(F.least(B.intersection_area(F.col("box_a"), F.col("box_b")), "area_a", "area_b")) > threshold)
        iou = over(polygon_intersection_area("flat_a", "flat_b"))
        out = out.unionByName(pairs.select("pred_id", "truth_id", iou.alias("iou")).where(F.col("iou") > least))
    return out


def polygon_point_matches(preds: DataFrame, points: DataFrame, most: float, cell: float = 64.0) -> DataFrame:
    """As ``point_matches`` for polygons: inside by ray casting, distances from the ring's centroid and border."""
    ring = P.ring_of_coco(F.col("flat"))
    left = preds.select("pred_id", ring.alias("ring"), P.flat_bounds(F.col("flat")).alias("shape"))
    pairs = contained_points(points, left, "x", "y", "shape", None, cell).where(P.contains_point(F.col("ring"), F.col("x"), F.col("y")))
    c = P.ring_centroid(F.col("ring"))
    relative = F.try_divide(F.hypot(F.col("x") - c["x"], F.col("y") - c["y"]), P.distance_to_ring(F.col("ring"), c["x"], c["y"]))
    return _nearest(pairs, "pred_id", relative, most)
