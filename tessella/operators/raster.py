"""Windows over rasters, and pixel blocks under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import pixels as X


def _truncated(c: Column) -> Column:
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")


def box_crop(labels: DataFrame, padding: float = 0.0, least_padding: int = 0) -> DataFrame:
    """The square window around each box and how far it sticks out of its raster ``(w, h)``.

    Padding is the larger of ``least_padding`` and half of ``padding`` of the side; the shorter
    side is widened to the longer; bounds are truncated. ``pad_*``: rows and columns of zeros.
    """
    s = F.col("shape")
    by = lambda side: F.greatest(F.lit(float(least_padding)), side * padding / 2) if padding else F.lit(float(least_padding))
    x0, x1 = s["minx"] - by(B.width(s)), s["maxx"] + by(B.width(s))
    y0, y1 = s["miny"] - by(B.height(s)), s["maxy"] + by(B.height(s))
    more_x = F.greatest((y1 - y0) - (x1 - x0), F.lit(0.0)) / 2
    more_y = F.greatest((x1 - x0) - (y1 - y0), F.lit(0.0)) / 2
    out = labels.select("*", *[_truncated(c).alias(n) for c, n in ((x0 - more_x, "left"), (y0 - more_y, "top"), (x1 + more_x, "right"), (y1 + more_y, "bottom"))])
    low = lambda c: F.greatest(F.col(c), F.lit(0))
    high = lambda c, lo, most: F.greatest(low(lo), F.least(F.col(c), F.col(most)))
    return out.select(
        "*",
        (low("left") - F.col("left")).alias("pad_left"),
        (low("top") - F.col("top")).alias("pad_top"),
        (F.col("right") - high("right", "left", "w")).alias("pad_right"),
        (F.col("bottom") - high("bottom", "top", "h")).alias("pad_bottom"),
    )


def polygon_tile(labels: DataFrame, size: int | None, variable: bool = False, buffer: int = 0, least: int | None = None) -> DataFrame:
    """A square window centred on each shape, and the shape clipped to it and moved to its origin.

    Fixed ``size``, or twice the farthest side from the centroid plus twice the buffer, at most
    ``size`` and at least ``least``; truncated.
    """
    s = F.col("shape")
    cx, cy = B.centroid(s)
    final = F.lit(size)
    if variable:
        final = F.greatest(cx - s["minx"], s["maxx"] - cx, cy - s["miny"], s["maxy"] - cy) * 2 + 2 * buffer
        final = F.least(F.lit(float(size)), final) if size is not None else final
        final = F.greatest(F.lit(float(least)), final) if least is not None else final
    out = labels.withColumn("tile_size", F.floor(final).cast("int"))
    out = out.withColumn("col_off", F.floor(cx - F.col("tile_size") / 2).cast("long")).withColumn("row_off", F.floor(cy - F.col("tile_size") / 2).cast("long"))
    window = B.box("col_off", "row_off", F.col("col_off") + F.col("tile_size"), F.col("row_off") + F.col("tile_size"))
    return out.withColumn("clipped", B.translate(B.intersection(s, window), -F.col("col_off"), -F.col("row_off")))


def not_empty(tiles: DataFrame, bands: list[str], threshold: float) -> DataFrame:
    """Tiles whose share of empty pixels is under ``threshold``; 1 or more keeps all without a look."""
    if threshold >= 1:
        return tiles
    return tiles.where(F.coalesce(X.empty_share([F.col(b) for b in bands]), F.lit(1.0)) < threshold)


def windows_of_blocks(tiles: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Pixels of each tile, blanks as 0: ``blocks(raster_id, block_row, block_col, pixels)``, square and row by row.

    Tiles meet the blocks under them by an equi-join on the block's place, so every block is
    read once; a tile's pixels are cut from its blocks and put in order.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))
    under = tiles.withColumn("block_row", F.explode(span("tile.miny", "tile.maxy"))).withColumn("block_col", F.explode(span("tile.minx", "tile.maxx")))
    found = under.join(blocks, ["raster_id", "block_row", "block_col"], "left")
    at = F.posexplode_outer("pixels").alias("at", "value")
    px = found.select("raster_id", "tile_id", "tile", "block_row", "block_col", at)
    y, x = F.col("block_row") * block + F.floor(F.col("at") / block), F.col("block_col") * block + F.col("at") % block
    px = px.withColumn("y", y - F.col("tile.miny")).withColumn("x", x - F.col("tile.minx"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < B.width(F.col("tile"))) & (F.col("y") < B.height(F.col("tile")))
    placed = F.when(inside, F.struct((F.col("y") * B.width(F.col("tile")) + F.col("x")).alias("k"), "value"))
    got = px.groupBy("raster_id", "tile_id").agg(F.first("tile").alias("tile"), F.map_from_entries(F.collect_list(placed)).alias("known"))
    size = (B.width(F.col("tile")) * B.height(F.col("tile"))).cast("long")
    return got.select("raster_id", "tile_id", "tile", F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.coalesce(F.try_element_at("known", k), F.lit(0))).alias("pixels"))
