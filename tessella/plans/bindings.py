"""The engine's tables - rasters, labels, areas, points - derived from the star schema by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.operators.grid import tile_grid
from tessella.session import table

SIZE, OVERLAP, STEP = 128, 0.25, 96
FEW_RASTERS = 10_000  # about a MB where they are broadcast


def rasters(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("raster_id"), (600 + 100 * (key % 5)).alias("w"), (400 + 50 * (key % 7)).alias("h"))


def _on_rasters(spark: SparkSession, d: str, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with the rasters in turn.

    Rasters grow with the tables, and the planner knows only how well their file is packed. Their number decides: few
    are broadcast, since as keys of a shuffle they would be skewed; many never pass through the driver.
    """
    own = rasters(spark, d)
    n = own.count()
    return df.join(own.hint("broadcast" if n <= FEW_RASTERS else "merge"), (F.col(key) % n) == F.col("raster_id"))


def _placed(spark: SparkSession, d: str, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` on the rasters in turn, each with a whole-pixel box."""
    out, k = _on_rasters(spark, d, df, key), F.col(key)
    x, y = (k * 37) % F.col("w"), (k * 53) % F.col("h")
    return out.withColumn("shape", B.box(x, y, x + 8 + k % 41, y + 8 + k % 29))


def labels(spark: SparkSession, d: str) -> DataFrame:
    out = _placed(spark, d, table(spark, d, "events").select("event_id", "event_type", "value", "props"), "event_id")
    return out.select(F.col("event_id").alias("label_id"), "raster_id", "w", "h", "shape", F.col("event_type").alias("category"), (F.col("value") / 500).alias("score"), "props")


def truth(spark: SparkSession, d: str) -> DataFrame:
    out = _placed(spark, d, table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return out.select(F.col("o_orderkey").alias("truth_id"), "raster_id", "shape", F.col("o_orderpriority").alias("category"))


def points(spark: SparkSession, d: str) -> DataFrame:
    out, k = _on_rasters(spark, d, table(spark, d, "customer").select("c_custkey"), "c_custkey"), F.col("c_custkey")
    return out.select(k.alias("point_id"), "raster_id", ((k * 41) % F.col("w") + 0.5).cast("double").alias("x"), ((k * 59) % F.col("h") + 0.5).cast("double").alias("y"))


def tiles(spark: SparkSession, d: str, checked: bool = False) -> DataFrame:
    return tile_grid(rasters(spark, d), SIZE, OVERLAP, checked)


def features(spark: SparkSession, d: str) -> DataFrame:
    """Five disjoint features on each raster, in three areas."""
    k = F.col("n_nationkey")
    part = F.floor(k / 5)
    own = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == part % 3)
    x, y = part * 160 + 5, (k % 5) * 20
    own = own.select((k % 5).alias("turn"), F.col("r_name").alias("aoi"), B.box(x, y, x + 150, y + 300).alias("area"))
    return rasters(spark, d).join(F.broadcast(own), F.col("raster_id") % 5 == F.col("turn")).select("raster_id", "aoi", "area")


def global_area(spark: SparkSession, d: str) -> DataFrame:
    return rasters(spark, d).select("raster_id", B.box(F.lit(100).cast("long"), F.lit(100).cast("long"), F.col("w") - 150, F.col("h") - 50).alias("area"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    own = labels(spark, d)
    return own.select(F.col("label_id").alias("pred_id"), "raster_id", F.col("raster_id").alias("tile_id"), "shape", "score", F.col("score").alias("s1"), ((F.col("label_id") % 97) / 97).alias("s2"))


def extents(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rasters(spark, d).select(F.col("raster_id").alias("tile_id"), B.box(zero, zero, "w", "h").alias("extent"))


def mixed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on one ground of 100,000 by 80,000, from a pixel to 16,384 wide."""
    k = F.col("event_id")
    x, y, side = (k * 7919) % 100_000, (k * 6101) % 80_000, F.call_function("shiftleft", F.lit(1).cast("long"), (k % 15).cast("int"))
    return table(spark, d, "events").select(k.alias("box_id"), B.box(x, y, x + side, y + side + k % 3).alias("shape"))


def cloud_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("point_id"), ((k * 31) % 1000).alias("x"), ((k * 17) % 900).alias("y"), (k % 5).alias("z"), F.col("o_totalprice").alias("price"))


def cloud_regions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with a box as a hole, on the ground of the cloud, their sides between its points."""
    k = F.col("s_suppkey")
    x, y, w, h = (k * 73) % 900 + 0.5, (k * 59) % 800 + 0.5, 40 + k % 60, 40 + k % 50
    square = lambda x0, y0, x1, y1: F.array(*[c.cast("double") for c in (x0, y0, x1, y0, x1, y1, x0, y1)])
    rings = F.array(square(x, y, x + w, y + h), square(x + 10, y + 10, x + w - 10, y + h - 10))
    return table(spark, d, "supplier").select(k.alias("label_id"), (k % 7).cast("string").alias("category"), rings.alias("rings"))


#: The same tables for DuckDB.
SQL = f"""rasters AS (SELECT s_suppkey AS raster_id, 600 + 100 * (s_suppkey % 5) AS w, 400 + 50 * (s_suppkey % 7) AS h FROM supplier),
labels AS (
  SELECT event_id AS label_id, raster_id, w, h, (event_id * 37) % w AS x0, (event_id * 53) % h AS y0, (event_id * 37) % w + 8 + event_id % 41 AS x1, (event_id * 53) % h + 8 + event_id % 29 AS y1,
    event_type AS category, value / 500 AS score, value / 500 AS s1, (event_id % 97) / 97 AS s2, props
  FROM events JOIN rasters ON raster_id = event_id % (SELECT count(*) FROM supplier)),
truth AS (
  SELECT o_orderkey AS truth_id, raster_id, (o_orderkey * 37) % w AS x0, (o_orderkey * 53) % h AS y0, (o_orderkey * 37) % w + 8 + o_orderkey % 41 AS x1, (o_orderkey * 53) % h + 8 + o_orderkey % 29 AS y1,
    o_orderpriority AS category
  FROM orders JOIN rasters ON raster_id = o_orderkey % (SELECT count(*) FROM supplier)),
points AS (
  SELECT c_custkey AS point_id, raster_id, (c_custkey * 41) % w + 0.5 AS x, (c_custkey * 59) % h + 0.5 AS y
  FROM customer JOIN rasters ON raster_id = c_custkey % (SELECT count(*) FROM supplier)),
tiles AS (
  SELECT raster_id, w, h, i, i * CAST(ceil(w / {STEP}) AS BIGINT) + j AS tile_id, i * {STEP} AS row, j * {STEP} AS col
  FROM rasters, unnest(range(0, CAST(ceil(h / {STEP}) AS BIGINT))) AS a(i), unnest(range(0, CAST(ceil(w / {STEP}) AS BIGINT))) AS b(j)),
features AS (
  SELECT raster_id, r_name AS aoi, n_nationkey // 5 * 160 + 5 AS a0, n_nationkey % 5 * 20 AS b0, n_nationkey // 5 * 160 + 155 AS a1, n_nationkey % 5 * 20 + 300 AS b1
  FROM rasters JOIN nation ON raster_id % 5 = n_nationkey % 5 JOIN region ON r_regionkey = n_nationkey // 5 % 3),
mixed AS (
  SELECT event_id AS box_id, (event_id * 7919) % 100000 AS x0, (event_id * 6101) % 80000 AS y0, (event_id * 7919) % 100000 + (1 << (event_id % 15)) AS x1, (event_id * 6101) % 80000 + (1 << (event_id % 15)) + event_id % 3 AS y1
  FROM events),
cloud AS (SELECT o_orderkey AS point_id, (o_orderkey * 31) % 1000 AS x, (o_orderkey * 17) % 900 AS y, o_orderkey % 5 AS z, o_totalprice AS price FROM orders),
regions AS (
  SELECT s_suppkey AS label_id, CAST(s_suppkey % 7 AS VARCHAR) AS category, (s_suppkey * 73) % 900 + 0.5 AS x0, (s_suppkey * 59) % 800 + 0.5 AS y0,
    (s_suppkey * 73) % 900 + 0.5 + 40 + s_suppkey % 60 AS x1, (s_suppkey * 59) % 800 + 0.5 + 40 + s_suppkey % 50 AS y1 FROM supplier),
pairs AS (
  SELECT t.raster_id, t.tile_id, t.row, t.col, label_id, x0, y0, x1, y1, greatest(x0, col) AS c0, greatest(y0, row) AS d0, least(x1, col + {SIZE}) AS c1, least(y1, row + {SIZE}) AS d1
  FROM tiles AS t JOIN labels AS l ON t.raster_id = l.raster_id AND x0 < col + {SIZE} AND col < x1 AND y0 < row + {SIZE} AND row < y1),
most AS (SELECT *, (c1 - c0) * (d1 - d0) AS common FROM pairs WHERE 10 * (c1 - c0) * (d1 - d0) > 9 * (x1 - x0) * (y1 - y0))"""
