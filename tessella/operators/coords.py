"""Between pixels and coordinates: tile extents, labels to a raster's pixels and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import affine as A
from tessella.functions import box as B
from tessella.functions import projection as J


def extents(tiles: DataFrame) -> DataFrame:
    """``extent`` of each tile ``(width, height, transform)`` in its coordinates."""
    zero = F.lit(0).cast("double")
    return tiles.withColumn("extent", A.apply_box(F.col("transform"), B.box(zero, zero, F.col("width").cast("double"), F.col("height").cast("double"))))


def to_coordinates(labels: DataFrame, tiles: DataFrame, key: str = "file_name", source: int | None = None, target: int | None = None) -> DataFrame:
    """Shapes in tile pixels put into coordinates by their tile's transform, and into the common system ``target``."""
    own = tiles.select(F.col(key).alias("of_tile"), "transform")
    out = labels.join(own, F.col(key) == F.col("of_tile")).drop("of_tile")
    t = F.col("transform")
    moved = F.transform("shape", lambda part: F.transform(part, lambda ring: A.apply_ring(t, ring)))
    return reprojected(out.withColumn("shape", moved).drop("transform"), source, target)


def reprojected(df: DataFrame, source: int | None, target: int | None, shape: str = "shape") -> DataFrame:
    """Every vertex from one system to another; equal systems and shapes without one stay."""
    if source == target or source is None:
        return df

    def vertex(p):
        x, y = J.reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return df.withColumn(shape, F.transform(shape, lambda part: F.transform(part, lambda ring: F.transform(ring, vertex))))


def to_pixels(labels: DataFrame, rasters: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """Shapes in coordinates put into their raster's pixels: ``rasters(raster_id, transform)``."""
    own = rasters.select(F.col("raster_id").alias("of_raster"), A.inverse(F.col("transform")).alias("back"))
    out = reprojected(labels, source, target).join(own, F.col("raster_id") == F.col("of_raster")).drop("of_raster")
    t = F.col("back")
    return out.withColumn("shape", F.transform("shape", lambda part: F.transform(part, lambda ring: A.apply_ring(t, ring)))).drop("back")
