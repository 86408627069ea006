"""Tile grids over rasters and point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.box import box
from tessella.session import spread, written


def step_of(size: int, overlap: float) -> int:
    """``int((1 - overlap) * size)`` in double arithmetic; a step of 0 is refused."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    step = int((1 - overlap) * size)
    if step < 1:
        raise ValueError("tiles overlap so much that the step is 0")
    return step


def tile_grid(rasters: DataFrame, size: int, overlap: float = 0.0, checked: bool = False) -> DataFrame:
    """``rasters(raster_id, w, h)`` -> ``(raster_id, tile_id, row, col, tile)``: windows row by row, never clipped.

    ``checked``: the rows that remain when pixels are looked at - row 0 and every further
    row k * step whose predecessor's window ends above the raster's bottom. Ids are dense
    in each raster and computed, not counted, so tiles are neither sorted nor shuffled; rasters are dealt
    over all cores, since a small file of them stands for many tiles.
    """
    step = step_of(size, overlap)
    axis = lambda n: F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1)
    grid = spread(rasters.where("w > 0 and h > 0").select("raster_id", "w", "h")).select("raster_id", "h", F.ceil(F.col("w") / step).cast("long").alias("n_cols"), F.explode(axis(F.col("h"))).alias("i"), axis(F.col("w")).alias("js"))
    if checked:
        grid = grid.where((F.col("i") == 0) | (size + (F.col("i") - 1) * step < F.col("h")))
    grid = grid.select("raster_id", "n_cols", "i", F.explode("js").alias("j"))
    row, col = F.col("i") * step, F.col("j") * step
    return grid.select(
        "raster_id",
        (F.col("i") * F.col("n_cols") + F.col("j")).alias("tile_id"),
        row.alias("row"),
        col.alias("col"),
        box(col, row, col + size, row + size).alias("tile"),
    )


def cell_of(row: Column, col: Column, step: int) -> tuple[Column, Column]:
    """Grid row and column of a tile."""
    return F.floor(row / step).cast("int"), F.floor(col / step).cast("int")


def cloud_grid(clouds: DataFrame, side: float, overlap: float = 0.0) -> DataFrame:
    """``clouds(cloud_id, minx, miny, maxx, maxy)`` -> ``(cloud_id, tile_id, grid_row, grid_col, tile)``, y first.

    Origins are minimum + k * step below the maximum.
    """
    step = side * (1 - overlap)
    count = lambda a, b: F.ceil((F.col(b) - F.col(a)) / step).cast("int")
    own = clouds.select("*", count("minx", "maxx").alias("n_cols"), count("miny", "maxy").alias("n_rows")).where("n_cols > 0 and n_rows > 0")
    own = own.withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("grid_col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    x, y = F.col("minx") + F.col("grid_col") * step, F.col("miny") + F.col("grid_row") * step
    tile_id = F.col("grid_row").cast("long") * F.col("n_cols") + F.col("grid_col")
    return own.select("cloud_id", tile_id.alias("tile_id"), "grid_row", "grid_col", box(x, y, x + side, y + side).alias("tile"))


def reference_grid(rasters: DataFrame, size: int, overlap: float = 0.0) -> DataFrame:
    """A cloud grid that lies on rasters ``(raster_id, width, height, transform)``: tiles of ``size`` pixels, sides in coordinates.

    ``-> (cloud_id, tile_id, grid_row, grid_col, tile, x_resolution, y_resolution)``. The bounds are those of the raster's
    corners and the resolutions lengths of a pixel's sides, so rotated rasters are covered too. A tile's side is ``size`` times
    the coarser resolution.
    """
    t = F.col("transform")
    x, y = F.hypot(t["a"], t["d"]), F.hypot(t["b"], t["e"])
    corners = [(F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.lit(0), F.col("height")), (F.col("width"), F.col("height"))]
    xs = [t["a"] * i + t["b"] * j + t["c"] for i, j in corners]
    ys = [t["d"] * i + t["e"] * j + t["f"] for i, j in corners]
    ends = {"minx": F.least(*xs), "miny": F.least(*ys), "maxx": F.greatest(*xs), "maxy": F.greatest(*ys)}
    own = rasters.select(F.col("raster_id").alias("cloud_id"), x.alias("x_resolution"), y.alias("y_resolution"), (size * F.greatest(x, y)).alias("side"), *[c.cast("double").alias(n) for n, c in ends.items()])
    step = F.col("side") * (1 - overlap)
    count = lambda a, b: F.ceil((F.col(b) - F.col(a)) / step).cast("int")
    own = own.withColumn("n_cols", count("minx", "maxx")).withColumn("n_rows", count("miny", "maxy")).where("side > 0 and n_cols > 0 and n_rows > 0")
    own = own.withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("grid_col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    left, low = F.col("minx") + F.col("grid_col") * step, F.col("miny") + F.col("grid_row") * step
    tile_id = F.col("grid_row").cast("long") * F.col("n_cols") + F.col("grid_col")
    return own.select("cloud_id", tile_id.alias("tile_id"), "grid_row", "grid_col", box(left, low, left + F.col("side"), low + F.col("side")).alias("tile"), "x_resolution", "y_resolution")


def within_limit(tiles: DataFrame, most: int, force: bool = False) -> DataFrame:
    """The tiles; an error if there are more than ``most``, unless forced."""
    if not force and tiles.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} tiles; pass force=True to allow that")
    return tiles


def dense_index(df: DataFrame, *order: str, name: str = "idx", within: str | None = None, start: int = 0) -> DataFrame:
    """Number rows from ``start`` by a total order; without ``within`` by range partitions, not in one task."""
    if within:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(within).orderBy(*order)) - 1 + start).cast("long"))
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    parts = written(parts, "indexed")
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + start).drop("_part", "_place", "_before")
