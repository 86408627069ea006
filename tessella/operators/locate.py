"""Points in polygons by a banded index of edges.

Boxes choose the candidates, through the quadtree. A region's height is cut into bands of a few edges each, and
every edge stands in the bands that it spans; a candidate meets only the edges in its own band, by an equi-join on
region and band, and lies inside if a ray to the right crosses an odd number of them. Holes and several parts need no
care; no region is ever gathered in one place, and a region with many points is dealt over its bands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import polygon as P
from tessella.functions.box import box
from tessella.operators.spatial import quad_join
from tessella.session import spare_name, spread, written

BAND_EDGES = 4  # edges that a band should hold
MOST_BANDS = 1 << 16


def _band(y: Column) -> Column:
    return F.least(F.floor((y - F.col("low")) * F.col("n_bands") / F.col("height")), F.col("n_bands") - 1).cast("long")


def edge_index(regions: DataFrame, key: str, rings: str) -> tuple[DataFrame, DataFrame]:
    """``(key, region_box, low, height, n_bands)`` of each region with extent, and ``(key, band, x0, y0, x1, y1)`` of its edges that aren't level.

    ``rings``: arrays of flat coordinates, read even-odd. Both are written.
    """
    own = regions.select(F.col(key).alias("region_id"), F.filter(rings, lambda r: F.size(r) >= 6).alias("rings")).where(F.size("rings") > 0)
    own = written(own.withColumn("region_box", P.coco_bounds(F.col("rings"))).withColumn("n_bands", F.greatest(F.lit(1), F.least(F.lit(MOST_BANDS), F.floor(F.size(F.flatten("rings")) / (2 * BAND_EDGES))))), "regions")
    own = own.withColumn("low", F.col("region_box.miny").cast("double")).withColumn("height", (F.col("region_box.maxy") - F.col("region_box.miny")).cast("double")).where("height > 0")
    after = F.concat(F.slice("ring", F.lit(3), F.size("ring") - 2), F.slice("ring", 1, 2))
    ends = F.arrays_zip(F.col("ring").alias("from"), F.col("after").alias("to"))
    # coordinates in pairs: an x and the y behind it
    pairs = F.filter(F.zip_with(F.col("ends"), _shifted(F.col("ends")), lambda a, b: F.struct(a["from"].alias("x0"), b["from"].alias("y0"), a["to"].alias("x1"), b["to"].alias("y1"))), lambda _, i: i % 2 == 0)
    edges = own.select("region_id", "low", "height", "n_bands", F.explode("rings").alias("ring")).withColumn("after", after).withColumn("ends", ends)
    edges = edges.select("region_id", "low", "height", "n_bands", F.inline(pairs)).where("y0 <> y1")
    first, last = _band(F.least("y0", "y1")), _band(F.greatest("y0", "y1"))
    edges = edges.withColumn("band", F.explode(F.sequence(first, last)))
    return own.select("region_id", "region_box", "low", "height", "n_bands"), written(edges.select("region_id", "band", "x0", "y0", "x1", "y1"), "region_edges")


def _shifted(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.size(items))


def _distinct(rows: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The distinct values of ``columns``, written with a ``number`` for each."""
    return written(rows.select(*columns).distinct().withColumn(number, F.monotonically_increasing_id()), number)


def _numbered(rows: DataFrame, values: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The id column of ``rows``, their first, with the ``number`` of their values."""
    other = values.withColumnsRenamed({c: f"of_{c}" for c in columns})
    return rows.join(other, reduce(Column.__and__, [F.col(c) == F.col(f"of_{c}") for c in columns])).select(rows.columns[0], number)


def _met(points: DataFrame, regions: DataFrame, region_key: str, rings: str, point_key: str, scope: tuple[str, str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(spot, shape)`` of distinct places inside distinct shapes, ``(point_id, spot)`` and ``(region_id, shape)``.

    However many points lie in one place, or regions have one shape, they are judged once.
    """
    spot_columns, shape_columns = (["x", "y", "point_scope"], ["rings", "region_scope"]) if scope else (["x", "y"], ["rings"])
    own = points.select(F.col(point_key).alias("point_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")], *([F.col(scope[0]).alias("point_scope")] if scope else [])).dropna(subset=spot_columns)
    areas = regions.select(F.col(region_key).alias("region_id"), F.col(rings).alias("rings"), *([F.col(scope[1]).alias("region_scope")] if scope else [])).dropna(subset=shape_columns)
    spots, shapes = _distinct(own, spot_columns, "spot"), _distinct(areas, shape_columns, "shape")
    boxes, edges = edge_index(shapes, "shape", "rings")
    on = []
    if scope:
        boxes = boxes.join(shapes.select("shape", "region_scope"), F.col("region_id") == F.col("shape")).drop("shape")
        on = [("point_scope", "region_scope")]
    places = spots.withColumn("place", box("x", "y", "x", "y"))
    touch = lambda p, b: p["minx"].between(b["minx"], b["maxx"]) & p["miny"].between(b["miny"], b["maxy"])
    met = quad_join(places, boxes, "place", "region_box", on, touch)
    met = met.select("spot", F.col("region_id").alias("met_id"), F.col("x").alias("px"), F.col("y").alias("py"), _band(F.col("y")).alias("met_band"))
    spans = (F.col("y0") <= F.col("py")) != (F.col("y1") <= F.col("py"))
    crossed = F.col("px") < F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    pairs = met.join(edges, (F.col("met_id") == F.col("region_id")) & (F.col("met_band") == F.col("band")) & spans & crossed)
    pairs = pairs.groupBy("spot", F.col("region_id").alias("shape")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("spot", "shape")
    return written(pairs, "spots_in_shapes"), _numbered(own, spots, spot_columns, "spot"), _numbered(areas, shapes, shape_columns, "shape")


def located(points: DataFrame, regions: DataFrame, region_key: str = "label_id", rings: str = "rings", point_key: str = "point_id", scope: tuple[str, str] | None = None) -> DataFrame:
    """``(point_id, region_id)`` of points inside regions; ``scope`` names the columns of both that must be equal.

    Keys must be unique on their side. Of points on a border those on lower or left sides count as inside, as a
    rule. Null coordinates and regions match nothing. Distinct places are judged against distinct shapes; points of one
    place and regions of one shape only multiply the rows returned, over all cores.
    """
    pairs, of_spot, of_shape = _met(points, regions, region_key, rings, point_key, scope)
    named = pairs.join(of_shape.withColumnRenamed("shape", "of_shape"), F.col("shape") == F.col("of_shape")).select(F.col("spot").alias("met_spot"), "region_id")
    # few bytes come in and many rows may go out: dealt by number, or small inputs would share a few tasks
    dealt = spread(of_spot, "spot")
    return dealt.join(named.hint("shuffle_hash"), F.col("spot") == F.col("met_spot")).select("point_id", "region_id")


def labelled(points: DataFrame, labels: DataFrame, rings: str = "rings", scope: tuple[str, str] | None = None) -> DataFrame:
    """Every point with ``label_id`` and ``category`` of the region ``labels(label_id, category, rings)`` it lies in (the least id of several), null in none."""
    pairs, of_spot, of_shape = _met(points, labels, "label_id", rings, "point_id", scope)
    least = of_shape.groupBy(F.col("shape").alias("of_shape")).agg(F.min("region_id").alias("hit"))
    best = pairs.join(least, F.col("shape") == F.col("of_shape")).groupBy(F.col("spot").alias("met_spot")).agg(F.min("hit").alias("hit"))
    found = of_spot.join(best, F.col("spot") == F.col("met_spot"))
    hit, of_label = spare_name(points, "hit_point"), spare_name(points, "of_label")
    names = labels.select(F.col("label_id").alias(of_label), F.col("category").alias("category"))
    found = found.select(F.col("point_id").alias(hit), F.col("hit").alias("label_id"))
    return points.join(found, F.col("point_id") == F.col(hit), "left").join(names, F.col("label_id") == F.col(of_label), "left").drop(hit, of_label)
