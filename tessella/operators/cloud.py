"""Point clouds: dealing points to tiles, thinning, labelling, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.operators.spatial import cell_join, contained_points


def distinct_points(points: DataFrame, key: str = "point_id") -> DataFrame:
    """One point for each place (x, y, z), that of the least key."""
    rank = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy(key))
    return points.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def tile_points(points: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """Points with the tiles they lie in, borders taken in: ``tiles(tile_id, tile)``. Every point is read once."""
    corner = lambda c: F.floor(F.col(c) / cell)
    span = lambda a, b: F.sequence(F.floor(F.col(f"tile.{a}") / cell), F.floor(F.col(f"tile.{b}") / cell))
    grid = tiles.withColumn("other_x", F.explode(span("minx", "maxx"))).withColumn("other_y", F.explode(span("miny", "maxy")))
    own = points.withColumn("cell_x", corner("x")).withColumn("cell_y", corner("y"))
    t = F.col("tile")
    inside = F.col("x").between(t["minx"], t["maxx"]) & F.col("y").between(t["miny"], t["maxy"])
    return own.join(grid, (F.col("cell_x") == F.col("other_x")) & (F.col("cell_y") == F.col("other_y")) & inside).drop("cell_x", "cell_y", "other_x", "other_y")


def voxels(points: DataFrame, size: float, means: list[str], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``(vx, vy, vz, n, <means>)``: one row for each voxel with the means of the named columns."""
    at = [F.floor((F.col(c) - o) / size).cast("long").alias(v) for c, o, v in zip("xyz", origin, ("vx", "vy", "vz"), strict=True)]
    return points.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in means])


def labelled_points(points: DataFrame, labels: DataFrame, scope: list[tuple[str, str]] | None = None, cell: float = 64.0) -> DataFrame:
    """Every point with ``label_id`` and ``category`` of the label it lies in (the least id of several), null in none."""
    found = contained_points(points, labels, "x", "y", "shape", scope, cell).groupBy("point_id").agg(F.min(F.struct("label_id", "category")).alias("hit"))
    return points.join(found, "point_id", "left").select(*points.columns, F.col("hit.label_id").alias("label_id"), F.col("hit.category").alias("category"))


def inside_area(points: DataFrame, areas: DataFrame, scope: list[tuple[str, str]] | None = None, cell: float = 256.0) -> DataFrame:
    """Points inside some of the areas, once each."""
    hit = contained_points(points, areas, "x", "y", "area", scope, cell).select(F.col("point_id").alias("hit_id")).distinct()
    return points.join(hit, F.col("point_id") == F.col("hit_id"), "left_semi")


def bounds(tiles: DataFrame) -> DataFrame:
    """Bounds over a collection of tiles, NaN left out, and whether every tile is bounded on each axis."""
    out = []
    for a in "xyz":
        for f, side in ((F.min, "min"), (F.max, "max")):
            out.append(f(F.nanvl(f"{side}_{a}", F.lit(None).cast("double"))).alias(f"{side}_{a}"))
        bounded = F.col(f"min_{a}").isNotNull() & F.col(f"max_{a}").isNotNull()
        out.append(F.bool_and(bounded).alias(f"is_bounded_{a}"))
    return tiles.agg(F.count(F.lit(1)).alias("n_tiles"), *out)


def density(points: DataFrame) -> DataFrame:
    """``(n, density, resolution)``: points to the unit of area of their bounds, and one over its root."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    out = points.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)).cast("double"), area.cast("double")).alias("density"))
    return out.withColumn("resolution", F.try_divide(F.lit(1.0), F.sqrt("density")))


def best_areas(tiles: DataFrame, areas: DataFrame, cell: float = 256.0) -> DataFrame:
    """``(tile_id, aoi)``: the area that shares most ground with each cloud tile, ties to the least name."""
    pairs = cell_join(tiles, areas, "tile", "area", cell=cell)
    best = F.min(F.struct((-B.intersection_area(F.col("tile"), F.col("area"))).alias("less"), "aoi"))
    return pairs.groupBy("tile_id").agg(best.alias("best")).select("tile_id", F.col("best.aoi").alias("aoi"))
