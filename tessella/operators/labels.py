"""Label polygons (as boxes): cleaning, and their joins with tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import polygon as P
from tessella.functions.kernels import clip_to_box
from tessella.operators.spatial import cell_join, self_pairs
from tessella.session import spread, written


def cleaned(labels: DataFrame, rasters: DataFrame) -> DataFrame:
    """Labels with an area that meet their raster's box ``(raster_id, w, h)``."""
    own = rasters.select(F.col("raster_id").alias("of_raster"), B.box(F.lit(0), F.lit(0), "w", "h").alias("frame"))
    kept = labels.where(F.col("shape").isNotNull() & (B.area(F.col("shape")) > 0))
    return kept.join(own, (F.col("raster_id") == F.col("of_raster")) & B.intersects(F.col("shape"), F.col("frame"))).select(*labels.columns)


def of_categories(labels: DataFrame, keep: list[str]) -> DataFrame:
    if "category" not in labels.columns:
        raise ValueError("labels have no category")
    return labels.where(F.col("category").isin(keep))


def tile_overlap(tiles: DataFrame, labels: DataFrame, ratio: tuple[int, int] = (9, 10), cell: float = 128.0) -> DataFrame:
    """Pairs of a tile and a label of which more than ``ratio`` (as a fraction) lies in the tile.

    ``(raster_id, tile_id, row, col, tile, label_id, shape, common, common_area)``; the
    comparison is by cross products, so whole-pixel boxes are judged exactly.
    """
    num, den = ratio
    own = labels.select(F.col("raster_id").alias("of_raster"), "label_id", "shape")
    pairs = cell_join(tiles, own, "tile", "shape", [("raster_id", "of_raster")], cell).drop("of_raster")
    pairs = pairs.withColumn("common", B.intersection(F.col("tile"), F.col("shape"))).withColumn("common_area", B.area(F.col("common")))
    return pairs.where(F.col("common_area") * den > B.area(F.col("shape")) * num)


def tile_overlap_polygons(tiles: DataFrame, labels: DataFrame, ratio: float = 0.9, cell: float = 128.0) -> DataFrame:
    """As ``tile_overlap`` for polygons: ``labels(raster_id, label_id, flat)`` with flat coordinate lists.

    ``flat_common``: the polygon cut to the tile. Candidates come from the bounding boxes.
    """
    # written, so that coordinates are made once and not for each use of one, bounds and areas once for a polygon and not for every pair
    own = written(spread(labels.select(F.col("raster_id").alias("of_raster"), "label_id", "flat")), "label_flats")
    own = written(own.select("*", P.flat_bounds(F.col("flat")).alias("shape"), P.flat_area(F.col("flat")).alias("whole")), "label_polygons")
    pairs = cell_join(tiles, own, "tile", "shape", [("raster_id", "of_raster")], cell).drop("of_raster")
    t = F.col("tile")
    # no more can be common than the boxes' common ground; the rest needs no cutting
    pairs = pairs.where(B.intersection_area(t, F.col("shape")) * (1 + 1e-9) > ratio * F.col("whole"))
    pairs = pairs.withColumn("flat_common", clip_to_box("flat", *[t[c].cast("double") for c in ("minx", "miny", "maxx", "maxy")]))
    pairs = pairs.withColumn("common_area", P.flat_area(F.col("flat_common")))
    return pairs.where(F.col("common_area") > ratio * F.col("whole")).drop("whole")


def in_tile_pixels(pairs: DataFrame, least_side: float = 0.5) -> DataFrame:
    """``shape`` clipped to its tile and moved to the tile's origin; slivers go."""
    moved = pairs.withColumn("shape", B.translate(F.col("common"), -F.col("col"), -F.col("row")))
    return moved.where((B.area(F.col("shape")) > 0) & (B.width(F.col("shape")) > least_side) & (B.height(F.col("shape")) > least_side))


def labeled_tiles(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiles with a label."""
    return tiles.join(pairs.select("raster_id", "tile_id").distinct(), ["raster_id", "tile_id"], "left_semi")


def second_pass(pairs: DataFrame, features: DataFrame, ratio: float) -> DataFrame:
    """Clipped labels against the area of their tile: ``pairs(..., aoi, common)``, ``features(raster_id, aoi, area)``.

    The share is of what the tile kept of the label, not of the whole label.
    """
    own = features.select(F.col("raster_id").alias("of_raster"), F.col("aoi").alias("of_aoi"), "area")
    joined = cell_join(pairs, own, "common", "area", [("raster_id", "of_raster"), ("aoi", "of_aoi")])
    share = B.ioa(F.col("area"), F.col("common"))
    return joined.withColumn("ratio", share).where(F.col("ratio") > ratio).drop("of_raster", "of_aoi")


def without_overlaps(labels: DataFrame, scope: str = "raster_id", cell: float = 64.0) -> DataFrame:
    """Labels that share no area with any other: both sides of a pair go."""
    hit = self_pairs(labels, "label_id", "shape", scope, cell).select("label_id").distinct()
    return labels.join(hit, "label_id", "left_anti")
