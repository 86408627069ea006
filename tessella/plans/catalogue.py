"""Registered queries over the bound tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import affine as A
from tessella.functions import box as B
from tessella.functions import names as N
from tessella.functions import pixels as X
from tessella.functions import polygon as P
from tessella.functions import rle as R
from tessella.functions.buffer import buffer
from tessella.functions.kernels import polygon_runs, region_area
from tessella.operators import aoi, cloud, coco, coords, datasets, dissolve, grid, labels, locate, match, nms, raster, taxonomy, totals
from tessella.operators.spatial import contained_points
from tessella.plans import bindings as T
from tessella.plans import pipelines
from tessella.session import spread, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL over the bound tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {T.SQL}\n" if not sql.lstrip().startswith("WITH ") else ""
            ORACLES[f.__name__] = head + sql
        return f

    return add


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in columns]


def _corners(b: str) -> list[Column]:
    return _long(*(f"{b}.{c}" for c in ("minx", "miny", "maxx", "maxy")))


def _round(c, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---- tiles and labels


@query("SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM tiles")
def tile_grid(spark, d):
    return T.tiles(spark, d).select("raster_id", *_long("tile_id", "row", "col"))


@query(f"SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM tiles WHERE i = 0 OR {T.SIZE} + (i - 1) * {T.STEP} < h")
def tile_grid_checked(spark, d):
    return T.tiles(spark, d, checked=True).select("raster_id", *_long("tile_id", "row", "col"))


def _overlap(spark, d):
    return labels.tile_overlap(T.tiles(spark, d), T.labels(spark, d))


@query("SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, label_id, CAST(common AS BIGINT) AS inter_area FROM most")
def tile_label_overlap(spark, d):
    return _overlap(spark, d).select("raster_id", *_long("tile_id", "row", "col"), "label_id", F.col("common_area").cast("long").alias("inter_area"))


@query("SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, label_id, CAST(c0 - col AS BIGINT) AS minx, CAST(d0 - row AS BIGINT) AS miny, CAST(c1 - col AS BIGINT) AS maxx, CAST(d1 - row AS BIGINT) AS maxy FROM most WHERE c1 - c0 > 0.5 AND d1 - d0 > 0.5")
def tile_label_translated(spark, d):
    return labels.in_tile_pixels(_overlap(spark, d)).select("raster_id", *_long("tile_id"), "label_id", *_corners("shape"))


@query("SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id FROM tiles AS t WHERE EXISTS (SELECT 1 FROM most AS m WHERE m.raster_id = t.raster_id AND m.tile_id = t.tile_id)")
def labeled_tiles_only(spark, d):
    return labels.labeled_tiles(T.tiles(spark, d), _overlap(spark, d)).select("raster_id", *_long("tile_id"))


@query("SELECT label_id, category FROM labels WHERE category IN ('click', 'view') AND x0 <= w AND y0 <= h")
def label_clean(spark, d):
    return labels.of_categories(labels.cleaned(T.labels(spark, d), T.rasters(spark, d)), ["click", "view"]).select("label_id", "category")


@query("SELECT label_id FROM labels AS a WHERE NOT EXISTS (SELECT 1 FROM labels AS b WHERE a.raster_id = b.raster_id AND a.label_id <> b.label_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def remove_overlaps(spark, d):
    return labels.without_overlaps(T.labels(spark, d)).select("label_id")


def _flat(b: Column) -> Column:
    """A box as a polygon's flat coordinates."""
    return coco.box_to_coco(b)[0].cast("array<double>")


@query("SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, label_id, round(CAST(common AS DOUBLE), 6) AS common_area FROM most")
def tile_polygon_overlap(spark, d):
    own = T.labels(spark, d).select("raster_id", "label_id", _flat(F.col("shape")).alias("flat"))
    return labels.tile_overlap_polygons(T.tiles(spark, d), own, 0.9).select("raster_id", *_long("tile_id"), "label_id", _round("common_area").alias("common_area"))


def _middle(b: Column) -> tuple[Column, Column]:
    return tuple(F.floor((b[f"min{c}"] + b[f"max{c}"]) / 2) for c in "xy")


def _notched(b: Column) -> Column:
    """A box without its quarter of highest x and y, an L, as flat coordinates."""
    mx, my = _middle(b)
    corners = (b["minx"], b["miny"], b["maxx"], b["miny"], b["maxx"], my, mx, my, mx, b["maxy"], b["minx"], b["maxy"])
    return F.array(*(c.cast("double") for c in corners))


def _notched_table(df: DataFrame) -> DataFrame:
    """``df`` with an L ``flat`` for each ``shape``, written: polygons are stored rows, not expressions that each use repeats."""
    # the box is written first, so that its corners are plain columns where the L takes them
    return written(written(spread(df), "boxes").withColumn("flat", _notched(F.col("shape"))), "notched")


def _common(*sides: tuple[str, str, str, str]) -> str:
    """SQL of the common area of two boxes, each named by its four ends."""
    (ax, ay, au, av), (bx, by, bu, bv) = sides
    return f"greatest(least({au}, {bu}) - greatest({ax}, {bx}), 0) * greatest(least({av}, {bv}) - greatest({ay}, {by}), 0)"


def _ends(t: str, notch: bool = False) -> tuple[str, str, str, str]:
    first = (f"(({t}.x0 + {t}.x1) // 2)", f"(({t}.y0 + {t}.y1) // 2)") if notch else (f"{t}.x0", f"{t}.y0")
    return (*first, f"{t}.x1", f"{t}.y1")


def _box_common(a: str, b: str) -> str:
    return _common(_ends(a), _ends(b))


def _box_area(t: str) -> str:
    return f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"


def _notched_common(a: str, b: str) -> str:
    """SQL of the common area of two boxes without their quarter of highest x and y."""
    part = lambda m, n: _common(_ends(a, m), _ends(b, n))
    return f"({part(False, False)} - {part(True, False)} - {part(False, True)} + {part(True, True)})"


def _notched_area(t: str) -> str:
    return f"({_common(_ends(t), _ends(t))} - {_common(_ends(t, True), _ends(t, True))})"


_TILE_ENDS = ("t.col", "t.row", f"(t.col + {T.SIZE})", f"(t.row + {T.SIZE})")


@query(f"""SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, label_id, round(CAST(common AS DOUBLE), 6) AS common_area FROM (
  SELECT t.raster_id, tile_id, label_id, {_common(_TILE_ENDS, _ends("l"))} - {_common(_TILE_ENDS, _ends("l", True))} AS common, {_notched_area("l")} AS whole
  FROM tiles AS t JOIN labels AS l ON t.raster_id = l.raster_id AND x0 < col + {T.SIZE} AND col < x1 AND y0 < row + {T.SIZE} AND row < y1) WHERE 10 * common > 4 * whole""")
def tile_notched_overlap(spark, d):
    own = _notched_table(T.labels(spark, d).select("raster_id", "label_id", "shape"))
    return labels.tile_overlap_polygons(T.tiles(spark, d), own, 0.4).select("raster_id", *_long("tile_id"), "label_id", _round("common_area").alias("common_area"))


@query("SELECT label_id, round(500000 + 0.5e0 * x0, 6) AS x, round(5000000 - 0.5e0 * y1, 6) AS y, round((x1 - x0) * (y1 - y0) * 0.25e0, 6) AS area FROM labels")
def label_coordinates(spark, d):
    transform = A.affine(0.5, 0, 500000, 0, -0.5, 5000000)
    own = T.labels(spark, d).select("label_id", "raster_id", P.of_coco(F.array(_flat(F.col("shape")))).alias("shape"))
    out = coords.to_coordinates(own, T.rasters(spark, d).select("raster_id", transform.alias("transform")), "raster_id")
    b = P.bounds(F.col("shape"))
    return out.select("label_id", _round(b["minx"]).alias("x"), _round(b["miny"]).alias("y"), _round(P.area(F.col("shape"))).alias("area"))


# ---- areas of interest

AOIS = [aoi.Aoi("valid", 0.15, 1), aoi.Aoi("train", 0.7, 2), aoi.Aoi("test", 0.15, 3, "valid")]
_SHARES = """counts AS (SELECT raster_id, count(*) AS n FROM tiles GROUP BY raster_id),
shares(name, share, place, ord) AS (VALUES ('valid', 0.15e0, 1, 2), ('train', 0.7e0, 2, 1), ('test', 0.15e0, 3, 3)),
exact AS (SELECT raster_id, n, name, place, ord, share / (0.15e0 + 0.7e0 + 0.15e0) * n AS e FROM counts, shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY e - floor(e) DESC, ord) AS rk, n - sum(floor(e)) OVER (PARTITION BY raster_id) AS rest FROM exact),
quota AS (SELECT raster_id, name, place, n, CASE WHEN n < 3 THEN CASE WHEN ord <= n THEN 1 ELSE 0 END ELSE floor(e) + CASE WHEN rk <= rest THEN 1 ELSE 0 END END AS q FROM ranked),
bands AS (SELECT raster_id, name, sum(q) OVER (PARTITION BY raster_id ORDER BY place) - q AS lo, sum(q) OVER (PARTITION BY raster_id ORDER BY place) AS hi FROM quota),
placed AS (SELECT raster_id, tile_id, row_number() OVER (PARTITION BY raster_id ORDER BY col, row) - 1 AS rk FROM tiles),
banded AS (SELECT p.raster_id, p.tile_id, name AS aoi FROM placed AS p JOIN bands AS b ON p.raster_id = b.raster_id AND rk >= lo AND rk < hi)"""


@query(f"WITH {T.SQL},\n{_SHARES}\nSELECT raster_id, name AS aoi, CAST(q AS BIGINT) AS quota FROM quota")
def aoi_quota(spark, d):
    counts = T.tiles(spark, d).groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"))
    return aoi.quotas(counts, AOIS).select("raster_id", "aoi", *_long("quota"))


@query(f"WITH {T.SQL},\n{_SHARES}\nSELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, aoi FROM banded")
def aoi_band(spark, d):
    return aoi.band(T.tiles(spark, d), AOIS, T.STEP).select("raster_id", *_long("tile_id"), "aoi")


@query(f"WITH {T.SQL},\n{_SHARES}\nSELECT raster_id, CASE aoi WHEN 'test' THEN 'valid' ELSE aoi END AS aoi, count(*) AS n_tiles FROM banded GROUP BY ALL")
def aoi_rename(spark, d):
    return aoi.renamed(aoi.band(T.tiles(spark, d), AOIS, T.STEP), AOIS).groupBy("raster_id", "aoi").agg(F.count(F.lit(1)).alias("n_tiles"))


@query()
def aoi_corner(spark, d):
    return aoi.corner(T.tiles(spark, d), [aoi.Aoi("a", 0.5, 1), aoi.Aoi("b", 0.3, 2), aoi.Aoi("c", 0.2, 3)], T.STEP).select("raster_id", *_long("tile_id"), "aoi")


_MEET = f"a0 < col + {T.SIZE} AND col < a1 AND b0 < row + {T.SIZE} AND row < b1"
_TILE_AOI = f"""met AS (SELECT DISTINCT t.raster_id, tile_id, aoi FROM tiles AS t JOIN features AS f ON t.raster_id = f.raster_id AND {_MEET})"""


@query(f"""WITH {T.SQL},
{_TILE_AOI}
SELECT m.raster_id, CAST(m.tile_id AS BIGINT) AS tile_id, aoi, CAST(top + row_number() OVER (PARTITION BY m.raster_id ORDER BY aoi, m.tile_id) AS BIGINT) AS new_tile_id
FROM met AS m JOIN (SELECT raster_id, max(tile_id) AS top FROM tiles GROUP BY raster_id) AS x ON m.raster_id = x.raster_id""")
def aoi_package_tiles(spark, d):
    return aoi.package_tiles(T.tiles(spark, d), T.features(spark, d)).select("raster_id", *_long("tile_id"), "aoi", *_long("new_tile_id"))


@query("""SELECT label_id, aoi FROM (
  SELECT label_id, aoi, row_number() OVER (PARTITION BY label_id ORDER BY (least(x1, a1) - greatest(x0, a0)) * (least(y1, b1) - greatest(y0, b0)) DESC, aoi) AS rk
  FROM labels AS l JOIN features AS f ON l.raster_id = f.raster_id AND x0 < a1 AND a0 < x1 AND y0 < b1 AND b0 < y1) WHERE rk = 1""")
def aoi_package_polygons(spark, d):
    return aoi.package_polygons(T.labels(spark, d), T.features(spark, d)).select("label_id", "aoi")


@query(f"SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id FROM tiles WHERE 100 < col + {T.SIZE} AND col < w - 150 AND 100 < row + {T.SIZE} AND row < h - 50 AND w > 250 AND h > 150")
def aoi_global_restrict(spark, d):
    return aoi.restricted(T.tiles(spark, d).select("raster_id", "tile_id", "tile"), T.global_area(spark, d), "tile").select("raster_id", *_long("tile_id"))


@query(f"""WITH {T.SQL},
{_TILE_AOI}
SELECT p.raster_id, CAST(p.tile_id AS BIGINT) AS tile_id, p.label_id, m.aoi, round(CAST((least(c1, a1) - greatest(c0, a0)) * (least(d1, b1) - greatest(d0, b0)) AS DOUBLE) / common, 6) AS ratio
FROM most AS p JOIN met AS m ON p.raster_id = m.raster_id AND p.tile_id = m.tile_id
JOIN features AS f ON f.raster_id = p.raster_id AND f.aoi = m.aoi AND c0 < a1 AND a0 < c1 AND d0 < b1 AND b0 < d1
WHERE CAST((least(c1, a1) - greatest(c0, a0)) * (least(d1, b1) - greatest(d0, b0)) AS DOUBLE) / common > 0.25""")
def aoi_label_second_pass(spark, d):
    met = aoi.package_tiles(T.tiles(spark, d), T.features(spark, d)).select("raster_id", "tile_id", "aoi")
    pairs = _overlap(spark, d).join(met, ["raster_id", "tile_id"])
    return labels.second_pass(pairs, T.features(spark, d), 0.25).select("raster_id", *_long("tile_id"), "label_id", "aoi", _round("ratio").alias("ratio"))


@query("""SELECT label_id, aoi, round(s, 6) AS ratio FROM (
  SELECT label_id, aoi, sum(greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0)) / CAST(any_value((x1 - x0) * (y1 - y0)) AS DOUBLE) AS s
  FROM labels AS l JOIN features AS f ON l.raster_id = f.raster_id AND x0 <= a1 AND a0 <= x1 AND y0 <= b1 AND b0 <= y1 GROUP BY label_id, aoi) WHERE s >= 0.4 - 1e-9""")
def aoi_polygon_ratio(spark, d):
    return aoi.covered_ratio(T.labels(spark, d), T.features(spark, d), 0.4).select("label_id", "aoi", _round("ratio").alias("ratio"))


@query(f"""SELECT t.raster_id, CAST(tile_id AS BIGINT) AS tile_id, aoi, CAST({T.SIZE * T.SIZE} - sum((least(col + {T.SIZE}, a1) - greatest(col, a0)) * (least(row + {T.SIZE}, b1) - greatest(row, b0))) AS BIGINT) AS masked_px
FROM tiles AS t JOIN features AS f ON t.raster_id = f.raster_id AND {_MEET} GROUP BY ALL""")
def aoi_mask_pixels(spark, d):
    out = aoi.masked_pixels(T.tiles(spark, d), T.features(spark, d))
    return out.select("raster_id", *_long("tile_id"), "aoi", F.col("masked").cast("long").alias("masked_px"))


# ---- aggregation of predictions

WEIGHTS = {"s1": 0.25, "s2": 0.75}
_SAFE = "x0 >= 0.05e0 * w AND y0 >= 0.05e0 * w AND x1 <= w - 0.05e0 * w AND y1 <= h - 0.05e0 * w"


@query(f"SELECT label_id AS pred_id FROM labels WHERE {_SAFE} OR 2 * 0.05e0 * w >= least(w, h)")
def edge_filter(spark, d):
    return nms.off_edges(T.predictions(spark, d), T.extents(spark, d), 0.05).select("pred_id")


@query("SELECT label_id AS pred_id, round(coalesce(s1, 0) * 0.25 + coalesce(s2, 0) * 0.75, 6) AS score FROM labels")
def score_arith(spark, d):
    return nms.scored(T.predictions(spark, d), WEIGHTS, "weighted_arithmetic_mean").select("pred_id", _round("score").alias("score"))


@query("SELECT label_id AS pred_id, round(pow(coalesce(s1, 0), 0.25) * pow(coalesce(s2, 0), 0.75), 6) AS score FROM labels")
def score_geo(spark, d):
    return nms.scored(T.predictions(spark, d), WEIGHTS).select("pred_id", _round("score").alias("score"))


@query("SELECT label_id AS pred_id, round(1 / (0.25e0 / (coalesce(s1, 0) + 1e-12) + 0.75e0 / (coalesce(s2, 0) + 1e-12)), 6) AS score FROM labels")
def score_harm(spark, d):
    return nms.scored(T.predictions(spark, d), WEIGHTS, "weighted_harmonic_mean").select("pred_id", _round("score").alias("score"))


@query("SELECT label_id AS pred_id, round(score * (1 - sqrt(pow((x0 + x1 - w) / 2, 2) + pow((y0 + y1 - h) / 2, 2)) / sqrt(w * w + h * h) * 0.4e0), 6) AS score FROM labels")
def score_centroid(spark, d):
    return nms.centroid_scored(T.predictions(spark, d), T.extents(spark, d), 0.6).select("pred_id", _round("score").alias("score"))


@query("SELECT label_id AS pred_id FROM labels WHERE score >= 0.1e0 OR (SELECT count(*) FROM labels WHERE score <> 0) = 0")
def score_threshold(spark, d):
    return nms.over_threshold(T.predictions(spark, d), 0.1).select("pred_id")


def _walk_sql(source: str, num: int, den: int, common=_box_common, area=_box_area) -> str:
    """The sequential greedy walk over ``source(raster_id, id, x0, y0, x1, y1, score)``."""
    met = common("k", "r")
    return f"""WITH RECURSIVE {T.SQL},
source AS ({source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY score DESC, id) AS rk FROM source),
walk AS (
  SELECT raster_id, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS kept FROM rasters
  UNION ALL
  SELECT r.raster_id, r.rk, CASE WHEN len(list_filter(kept, lambda k: {den} * {met} > {num} * ({area("k")} + {area("r")} - {met}))) > 0 THEN kept
    ELSE list_append(kept, {{'id': r.id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) END
  FROM walk AS w JOIN ranked AS r ON r.raster_id = w.raster_id AND r.rk = w.rk + 1),
kept AS (SELECT raster_id, unnest(kept).id AS pred_id FROM walk WHERE (raster_id, rk) IN (SELECT (raster_id, max(rk)) FROM walk GROUP BY raster_id))
"""


@query(_walk_sql("SELECT raster_id, label_id AS id, x0, y0, x1, y1, score FROM labels", 3, 10) + "SELECT pred_id FROM kept")
def nms_iou(spark, d):
    return nms.greedy_nms(T.predictions(spark, d), 3, 10, "raster_id").select("pred_id")


@query(_walk_sql("SELECT raster_id, label_id AS id, x0, y0, x1, y1, score FROM labels", 3, 10, _notched_common, _notched_area) + "SELECT pred_id FROM kept")
def nms_notched(spark, d):
    own = _notched_table(T.predictions(spark, d).select("pred_id", "raster_id", "shape", "score"))
    return nms.greedy_nms(own, 3, 10, "raster_id", flat="flat").select("pred_id")


_BLEND = "pow(coalesce(s1, 0), 0.25) * pow(coalesce(s2, 0), 0.75)"


@query(_walk_sql(f"SELECT raster_id, label_id AS id, x0, y0, x1, y1, round({_BLEND}, 6) AS score FROM labels WHERE ({_SAFE} OR 2 * 0.05e0 * w >= least(w, h)) AND round({_BLEND}, 6) >= 0.1e0", 3, 10) + f"SELECT pred_id, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy, round({_BLEND}, 6) AS score, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM kept JOIN labels ON label_id = pred_id")
def aggregate_predictions(spark, d):
    inner = nms.off_edges(T.predictions(spark, d), T.extents(spark, d), 0.05)
    blended = nms.scored(inner, WEIGHTS).withColumn("score", _round("score"))
    kept = nms.greedy_nms(nms.over_threshold(blended, 0.1), 3, 10, "raster_id")
    return kept.select("pred_id", *_corners("shape"), "score", B.area(F.col("shape")).cast("long").alias("area"))


@query()
def nms_ioa_boxes(spark, d):
    return nms.ioa_disambiguated(T.predictions(spark, d), 0.5, 0.5, "raster_id").select("pred_id", F.size("pieces").alias("n_boxes"), "area")


@query()
def aoi_redistributed(spark, d):
    k = F.col("area")
    grown = T.features(spark, d).withColumn("area", B.box(k["minx"], k["miny"], k["maxx"] + 40, k["maxy"]))
    shares = [aoi.Aoi(r.r_name.replace(" ", ""), 0.2) for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    named = grown.withColumn("aoi", F.replace("aoi", F.lit(" "), F.lit("")))
    return aoi.redistributed(named, shares).select("raster_id", "aoi", *[F.col(f"area.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query()
def nms_ioa_polygons(spark, d):
    own = T.predictions(spark, d).withColumn("flat", _flat(F.col("shape")))
    return nms.ioa_disambiguated(own, 0.5, 0.5, "raster_id", flat="flat").select("pred_id", _round("area").alias("area"))


@query("""SELECT a.box_id, count(*) AS n_met, CAST(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS BIGINT) AS common_area
  FROM mixed AS a JOIN mixed AS b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.box_id <> b.box_id GROUP BY a.box_id""")
def mixed_size_overlap(spark, d):
    return totals.overlap_totals(T.mixed_boxes(spark, d), "box_id", "shape")


_FAN = "8 * sin(pi() / 16) / 2"  # area of a quarter's arc of eight chords, radius 1


@query(f"""SELECT label_id, round(a + 2 * p - 4 + 5 * 4 * {_FAN}, 6) AS grown, round(a - p + 5 - {_FAN}, 6) AS shrunk
  FROM (SELECT label_id, {_notched_area("l")} AS a, 2 * (x1 - x0 + y1 - y0) AS p FROM labels AS l)""")
def label_buffer_area(spark, d):
    own = _notched_table(T.labels(spark, d).select("label_id", "shape")).select("label_id", F.array("flat").alias("rings"))
    return own.select("label_id", *[_round(region_area(buffer("rings", by))).alias(c) for c, by in (("grown", 2.0), ("shrunk", -1.0))])


_NOTCHED_PIXELS = f"""pixels AS (
  SELECT DISTINCT l.raster_id, x, y FROM labels AS l, unnest(range(l.x0, l.x1)) AS a(x), unnest(range(l.y0, l.y1)) AS b(y)
  WHERE NOT (x >= {_ends("l", True)[0]} AND y >= {_ends("l", True)[1]}))"""


@query(f"""WITH {T.SQL}, {_NOTCHED_PIXELS},
sides AS (SELECT raster_id, x + dx AS x, y + dy AS y FROM pixels, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)),
border AS (SELECT s.raster_id, count(*) AS n FROM sides AS s ANTI JOIN pixels AS p ON s.raster_id = p.raster_id AND s.x = p.x AND s.y = p.y GROUP BY s.raster_id)
SELECT raster_id, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(n) AS DOUBLE) AS border FROM pixels JOIN border USING (raster_id) GROUP BY raster_id""")
def union_outline(spark, d):
    own = _notched_table(T.labels(spark, d).select("raster_id", "shape")).select("raster_id", F.array("flat").alias("rings"))
    out = dissolve.union_rings(own, "raster_id", "rings", 64.0)
    after = F.concat(F.slice("ring", F.lit(3), F.size("ring") - 2), F.slice("ring", 1, 2))
    length = F.aggregate(F.zip_with("ring", after, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("raster_id").agg(_round(F.sum("area")).alias("area"), _round(F.sum(length)).alias("border"))


@query(f"""WITH {T.SQL}, pixels AS (
  SELECT DISTINCT l.raster_id, l.label_id % 2 AS side, x, y FROM labels AS l, unnest(range(l.x0, l.x1)) AS a(x), unnest(range(l.y0, l.y1)) AS b(y)
  WHERE NOT (x >= {_ends("l", True)[0]} AND y >= {_ends("l", True)[1]})),
sides AS (SELECT raster_id, x, y, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM pixels GROUP BY raster_id, x, y)
SELECT raster_id, CAST(count(*) FILTER (a AND NOT b) AS DOUBLE) AS only_left, CAST(count(*) FILTER (a AND b) AS DOUBLE) AS common, CAST(count(*) FILTER (b AND NOT a) AS DOUBLE) AS only_right FROM sides GROUP BY raster_id""")
def region_set_areas(spark, d):
    own = _notched_table(T.labels(spark, d).select("raster_id", "label_id", "shape")).withColumn("rings", F.array("flat"))
    sides = [own.where(F.col("label_id") % 2 == k).select("raster_id", "rings") for k in (0, 1)]
    areas = dissolve.set_areas(*sides, "raster_id", "rings", 64.0)
    return areas.select("raster_id", *[_round(p).alias(p) for p in dissolve.PARTS])


# ---- matching

_IOU = "greatest(least(l.x1, t.x1) - greatest(l.x0, t.x0), 0) * greatest(least(l.y1, t.y1) - greatest(l.y0, t.y0), 0)"


@query(f"""SELECT pred_id, truth_id, truth_category, round(CAST(c AS DOUBLE) / u, 6) AS iou FROM (
  SELECT label_id AS pred_id, truth_id, t.category AS truth_category, {_IOU} AS c, (l.x1 - l.x0) * (l.y1 - l.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_IOU} AS u
  FROM labels AS l JOIN truth AS t ON l.raster_id = t.raster_id AND l.x0 < t.x1 AND t.x0 < l.x1 AND l.y0 < t.y1 AND t.y0 < l.y1) WHERE 2 * c > u""")
def match_iou(spark, d):
    preds = T.predictions(spark, d).select("pred_id", "raster_id", "shape")
    return match.iou_matches(preds, T.truth(spark, d), 1, 2, "raster_id").select("pred_id", "truth_id", "truth_category", _round("iou").alias("iou"))


@query(f"""SELECT pred_id, truth_id, round(CAST(c AS DOUBLE) / u, 6) AS iou FROM (
  SELECT label_id AS pred_id, truth_id, {_IOU} AS c, (l.x1 - l.x0) * (l.y1 - l.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_IOU} AS u
  FROM labels AS l JOIN truth AS t ON l.raster_id = t.raster_id AND l.x0 < t.x1 AND t.x0 < l.x1 AND l.y0 < t.y1 AND t.y0 < l.y1) WHERE 10 * c > 6 * u""")
def match_polygons(spark, d):
    preds = T.predictions(spark, d).select("pred_id", "raster_id", _flat(F.col("shape")).alias("flat"))
    truth = T.truth(spark, d).select("truth_id", "raster_id", _flat(F.col("shape")).alias("flat"))
    return match.polygon_matches(preds, truth, 0.6, "raster_id").select("pred_id", "truth_id", _round("iou").alias("iou"))


@query(f"""SELECT pred_id, truth_id, round(CAST(c AS DOUBLE) / u, 12) AS iou FROM (
  SELECT label_id AS pred_id, truth_id, {_notched_common("l", "t")} AS c, {_notched_area("l")} + {_notched_area("t")} - {_notched_common("l", "t")} AS u
  FROM labels AS l JOIN truth AS t ON l.raster_id = t.raster_id AND l.x0 < t.x1 AND t.x0 < l.x1 AND l.y0 < t.y1 AND t.y0 < l.y1) WHERE 10 * c > 4 * u""")
def match_notched(spark, d):
    preds = _notched_table(T.predictions(spark, d).select("pred_id", "raster_id", "shape"))
    truth = _notched_table(T.truth(spark, d).select("truth_id", "raster_id", "shape"))
    return match.polygon_matches(preds, truth, 0.4, "raster_id").select("pred_id", "truth_id", _round("iou", 12).alias("iou"))


@query(f"""SELECT label_id, point_id FROM labels AS l JOIN points AS p ON l.raster_id = p.raster_id AND x > x0 AND x < x1 AND y > y0 AND y < y1
  WHERE NOT (x > {_ends("l", True)[0]} AND y > {_ends("l", True)[1]})""")
def points_in_notched(spark, d):
    own = _notched_table(T.labels(spark, d).select("label_id", F.col("raster_id").alias("of_raster"), "shape")).withColumn("ring", P.ring_of_coco(F.col("flat")))
    pairs = contained_points(T.points(spark, d), own, "x", "y", "shape", [("raster_id", "of_raster")])
    return pairs.where(P.contains_point(F.col("ring"), F.col("x"), F.col("y"))).select("label_id", "point_id")


@query("""SELECT pred_id, point_id, round(dist, 6) AS distance FROM (
  SELECT label_id AS pred_id, point_id, dist, row_number() OVER (PARTITION BY label_id ORDER BY dist, point_id) AS rk FROM (
    SELECT label_id, point_id, sqrt(pow(x - (x0 + x1) / 2, 2) + pow(y - (y0 + y1) / 2, 2)) / (least(x1 - x0, y1 - y0) / 2) AS dist
    FROM labels AS l JOIN points AS p ON l.raster_id = p.raster_id AND x0 < x AND x < x1 AND y0 < y AND y < y1)) WHERE rk = 1 AND dist < 1""")
def match_points(spark, d):
    preds = T.predictions(spark, d).select("pred_id", "raster_id", "shape")
    return match.point_matches(preds, T.points(spark, d), 1.0, "raster_id").select("pred_id", "point_id", _round("distance").alias("distance"))


# ---- geometry

_T = (0.5, 0.1, 1000.0, -0.2, -0.4, 5000.0)


@query("""SELECT label_id, round(0.5e0 * x0 + 0.1e0 * y0 + 1000, 6) AS x, round(-0.2e0 * x0 - 0.4e0 * y0 + 5000, 6) AS y, CAST(x0 AS DOUBLE) AS back_x, CAST(y0 AS DOUBLE) AS back_y FROM labels""")
def affine_roundtrip(spark, d):
    t = A.affine(*_T)
    x, y = A.forward(t, F.col("shape.minx").cast("double"), F.col("shape.miny").cast("double"))
    back = A.forward(A.inverse(t), x, y)
    return T.labels(spark, d).select("label_id", _round(x).alias("x"), _round(y).alias("y"), *[(_round(b) + 0.0).alias(f"back_{n}") for b, n in zip(back, "xy", strict=True)])


@query("SELECT c_custkey, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS BIGINT) AS epsg FROM (SELECT c_custkey, c_custkey % 360 - 180.0 AS lon, c_custkey % 160 - 80 AS lat FROM customer)")
def utm_zone(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", A.utm_zone((k % 360 - 180).cast("double"), k % 160 - 80).cast("long").alias("epsg"))


@query("SELECT label_id AS ann_id, array_to_string([x1, y0, x1, y1, x0, y1, x0, y0], ',') AS coords FROM labels")
def coco_coords(spark, d):
    flat = F.transform(coco.box_to_coco(F.col("shape"))[0], lambda v: v.cast("long").cast("string"))
    return T.labels(spark, d).select(F.col("label_id").alias("ann_id"), F.array_join(flat, ",").alias("coords"))


@query("SELECT label_id AS ann_id, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM labels")
def coco_bbox(spark, d):
    lists = coco.box_to_coco(F.col("shape"))
    out = T.labels(spark, d).select(F.col("label_id").alias("ann_id"), P.coco_bounds(lists).alias("b"), P.area(P.of_coco(lists)).alias("area"))
    return out.select("ann_id", *_corners("b"), "area")


_RUNS = """runs AS (
  SELECT label_id AS ann_id, x0 % 64 AS x, y0 % 64 AS y, x1 - x0 AS bw, y1 - y0 AS bh FROM labels)"""


@query(f"""WITH {T.SQL},
{_RUNS}
SELECT ann_id, CAST(bw * bh AS BIGINT) AS area, CAST(x AS BIGINT) AS minx, CAST(y AS BIGINT) AS miny, CAST(x + bw - 1 AS BIGINT) AS maxx, CAST(y + bh - 1 AS BIGINT) AS maxy, CAST(x * 128 + y AS BIGINT) AS first_run, CAST(2 * bw + 1 AS BIGINT) AS n_runs FROM runs""")
def rle_box(spark, d):
    s = F.col("shape")
    x, y = s["minx"] % 64, s["miny"] % 64
    b = B.box(x, y, x + B.width(s), y + B.height(s))
    runs = T.labels(spark, d).select(F.col("label_id").alias("ann_id"), R.box_runs(b, 128, 128).alias("runs"))
    return runs.select("ann_id", R.area("runs").cast("long").alias("area"), R.bounds("runs", 128).alias("b"), F.col("runs")[0].cast("long").alias("first_run"), F.size("runs").cast("long").alias("n_runs")).select("ann_id", "area", *_corners("b"), "first_run", "n_runs")


@query("SELECT label_id AS ann_id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM labels")
def mask_area(spark, d):
    s = F.col("shape")
    x, y = s["minx"] % 64, s["miny"] % 64
    b = B.box(x, y, x + B.width(s), y + B.height(s))
    text = R.encoded(R.box_runs(b, 128, 128))
    return T.labels(spark, d).select(F.col("label_id").alias("ann_id"), R.area(R.decoded(text)).cast("long").alias("area"))


@query(f"""SELECT label_id AS ann_id, CAST((x1 - x0 + 1) * (y1 - y0 + 1) - {_common(_ends("l", True), _ends("l", True))} AS BIGINT) AS area FROM labels AS l""")
def notched_mask_area(spark, d):
    s = F.col("shape")
    b = B.translate(s, s["minx"] % 64 - s["minx"], s["miny"] % 64 - s["miny"])
    own = _notched_table(T.labels(spark, d).select("label_id", b.alias("shape")))
    runs = polygon_runs(F.array("flat"), F.lit(128), F.lit(128))
    return own.select(F.col("label_id").alias("ann_id"), R.area(runs).cast("long").alias("area"))


# ---- COCO


def _categories(spark, d) -> DataFrame:
    found = coco.categories_of(T.labels(spark, d).where("category <> 'error'"))
    return found.withColumn("other_names", F.when(F.col("name") == "view", F.array(F.lit("error"))))


@query("""SELECT label_id, CAST(coalesce(c.id, -1) AS BIGINT) AS category_id FROM labels LEFT JOIN (
  SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT category AS name FROM labels WHERE category NOT IN ('error', 'click'))
  UNION ALL SELECT 'error', (SELECT count(DISTINCT category) FROM labels WHERE category NOT IN ('error', 'click') AND category <= 'view')) AS c ON category = c.name""")
def category_map(spark, d):
    found = coco.categories_of(T.labels(spark, d).where("category not in ('error', 'click')"))
    found = found.withColumn("other_names", F.when(F.col("name") == "view", F.array(F.lit("error"))))
    return coco.with_category_id(T.labels(spark, d), coco.category_ids(found)).select("label_id", "category_id")


def _named_labels(spark, d) -> DataFrame:
    own = coco.with_category_id(T.labels(spark, d), coco.category_ids(_categories(spark, d)))
    return own.withColumn("file_name", F.format_string("r_tile_noaoi_sf1p0_0_0_%d_%d_%d.tif", "w", "h", "raster_id"))


def _images(spark, d) -> DataFrame:
    own = T.rasters(spark, d).select(F.format_string("r_tile_noaoi_sf1p0_0_0_%d_%d_%d.tif", "w", "h", "raster_id").alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height"))
    return coco.images_of(own)


_COCO = """named AS (SELECT *, format('r_tile_noaoi_sf1p0_0_0_{}_{}_{}.tif', w, h, raster_id) AS file_name FROM labels),
images AS (SELECT row_number() OVER (ORDER BY file_name) AS id, file_name FROM (SELECT format('r_tile_noaoi_sf1p0_0_0_{}_{}_{}.tif', w, h, raster_id) AS file_name FROM rasters)),
cats AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT category AS name FROM labels WHERE category <> 'error')),
anns AS (
  SELECT row_number() OVER (ORDER BY i.id, label_id) AS id, label_id, i.id AS image_id, n.file_name, coalesce(c.id, v.id) AS category_id, x0, y0, x1, y1, score, props
  FROM named AS n JOIN images AS i ON n.file_name = i.file_name LEFT JOIN cats AS c ON n.category = c.name LEFT JOIN cats AS v ON v.name = 'view' AND n.category = 'error')"""


@query(f"""WITH {T.SQL},
{_COCO}
SELECT CAST(id AS BIGINT) AS id, CAST(image_id AS BIGINT) AS image_id, CAST(category_id AS BIGINT) AS category_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(x0 AS DOUBLE) AS bx, CAST(y0 AS DOUBLE) AS y, CAST(x1 - x0 AS DOUBLE) AS bw, round(score, 6) AS score FROM anns""")
def coco_annotations(spark, d):
    out = coco.annotations_of(_named_labels(spark, d), _images(spark, d), "score")
    return out.select(*_long("id", "image_id", "category_id"), "area", F.col("bbox")[0].alias("bx"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("bw"), _round("score").alias("score"))


@query(f"""WITH {T.SQL},
{_COCO}
SELECT CAST(row_number() OVER (ORDER BY file_name) - 1 AS BIGINT) AS tile_idx, file_name, n_labels FROM (SELECT file_name, count(*) AS n_labels FROM named GROUP BY file_name)""")
def coco_union_reindex(spark, d):
    images = _images(spark, d).withColumn("doc", F.col("id") % 2)
    own = _named_labels(spark, d).join(images.select(F.col("id").alias("image_id"), "doc", F.col("file_name").alias("image_name")), F.col("file_name") == F.col("image_name"))
    docs = images.select("doc").distinct()
    tiles, _ = coco.union_reindexed(images, own.select("doc", "image_id", "label_id"), _categories(spark, d).crossJoin(F.broadcast(docs)))
    return tiles.select("tile_idx", "file_name", "n_labels")


@query(f"""WITH {T.SQL},
{_COCO}
SELECT a.label_id AS ann_id, file_name, c.name AS category_name, json_extract_string(props, '$.k') AS attr_k FROM anns AS a LEFT JOIN cats AS c ON a.category_id = c.id""")
def coco_flatten(spark, d):
    own = _named_labels(spark, d).join(_images(spark, d).select(F.col("id").alias("image_id"), F.col("file_name").alias("image_name")), F.col("file_name") == F.col("image_name"))
    anns = own.select(F.col("label_id").alias("ann_id"), "image_id", "category_id", F.from_json("props", "map<string,string>").alias("other_attributes"))
    return coco.flattened(_images(spark, d), anns, _categories(spark, d), ["k"]).select("ann_id", "file_name", "category_name", "attr_k")


@query("SELECT raster_id AS image_id, CAST(f AS BIGINT) AS fold, CASE WHEN f = raster_id * 7 % 5 THEN 'valid' ELSE 'train' END AS part FROM rasters, range(5) AS r(f)")
def kfold(spark, d):
    own = T.rasters(spark, d)
    placed = own.select(F.col("raster_id").alias("image_id"), (F.col("raster_id") * 7 % 5).cast("int").alias("own_fold"))
    return coco.folds(own.select(F.col("raster_id").alias("id")), 5, predefined=placed).select("image_id", *_long("fold"), "part")


# ---- taxonomy


def _taxa(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("family"), F.concat_ws(" ", "p_type", "p_brand").alias("genus"), F.concat_ws(" ", "p_type", "p_brand", F.substring_index("p_name", " ", 1)).alias("species"))


_TAXA = """rows AS (SELECT p_type AS f, p_type || ' ' || p_brand AS g, p_type || ' ' || p_brand || ' ' || split_part(p_name, ' ', 1) AS s FROM part),
fam AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT f AS name FROM rows)),
gen AS (SELECT g.name, (SELECT count(*) FROM fam) + row_number() OVER (ORDER BY p.id, g.name) AS id, p.id AS parent FROM (SELECT DISTINCT f, g AS name FROM rows) AS g JOIN fam AS p ON g.f = p.name),
spe AS (SELECT s.name, (SELECT count(*) FROM fam) + (SELECT count(*) FROM gen) + row_number() OVER (ORDER BY p.id, s.name) AS id, p.id AS parent FROM (SELECT DISTINCT g, s AS name FROM rows) AS s JOIN gen AS p ON s.g = p.name),
tree AS (SELECT id, name, 'family' AS rank, NULL AS supercategory FROM fam UNION ALL SELECT id, name, 'genus', parent FROM gen UNION ALL SELECT id, name, 'species', parent FROM spe)"""


@query(f"WITH {_TAXA}\nSELECT CAST(id AS BIGINT) AS id, name, rank, CAST(supercategory AS BIGINT) AS supercategory FROM tree")
def taxonomy_build(spark, d):
    return taxonomy.built(_taxa(spark, d)).select(*_long("id"), "name", "rank", *_long("supercategory"))


@query(f"""WITH {_TAXA},
base AS (SELECT * FROM tree WHERE rank <> 'species' AND id % 3 <> 0),
fresh AS (SELECT *, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY list_position(['family', 'genus', 'species'], rank), id) AS new_id FROM tree WHERE name NOT IN (SELECT name FROM base)),
ids AS (SELECT id AS old, new_id FROM fresh UNION ALL SELECT t.id, b.id FROM tree AS t JOIN base AS b USING (name))
SELECT CAST(id AS BIGINT) AS id, name, rank, CAST(supercategory AS BIGINT) AS supercategory FROM base
UNION ALL SELECT CAST(f.new_id AS BIGINT), f.name, f.rank, CAST(p.new_id AS BIGINT) FROM fresh AS f LEFT JOIN ids AS p ON f.supercategory = p.old""")
def taxonomy_merge(spark, d):
    tree = taxonomy.built(_taxa(spark, d))
    return taxonomy.merged(tree.where("rank <> 'species' and id % 3 <> 0"), tree).select(*_long("id"), "name", "rank", *_long("supercategory"))


# ---- training items


def _item_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    tiles = T.rasters(spark, d).select(F.col("raster_id").alias("tile_idx"), F.col("w").alias("width"), F.col("h").alias("height"))
    own = T.labels(spark, d).select(F.col("raster_id").alias("tile_idx"), "label_id", "shape", F.when(F.col("label_id") % 5 != 0, F.col("label_id") % 5).alias("category_id"))
    return tiles, own


_PAD = "CAST(floor(greatest(x0 - (x1 - x0) * 0.1e0, 0)) AS BIGINT) AS p0, CAST(floor(greatest(y0 - (y1 - y0) * 0.1e0, 0)) AS BIGINT) AS q0, CAST(floor(least(x1 + (x1 - x0) * 0.1e0, w)) AS BIGINT) AS p1, CAST(floor(least(y1 + (y1 - y0) * 0.1e0, h)) AS BIGINT) AS q1"


@query(f"""SELECT raster_id AS tile_idx, string_agg(p0 || ',' || q0 || ',' || p1 || ',' || q1, ';' ORDER BY label_id) AS boxes, string_agg(CAST(label_id % 5 AS VARCHAR), ';' ORDER BY label_id) AS labels, CAST(sum((p1 - p0) * (q1 - q0)) AS BIGINT) AS area
FROM (SELECT raster_id, label_id, {_PAD} FROM labels) GROUP BY raster_id""")
def detection_items(spark, d):
    out = datasets.detection_items(*_item_tables(spark, d), padding=0.1)
    text = lambda c: F.array_join(c, ";")
    return out.select("tile_idx", text(F.transform("boxes", lambda b: F.array_join(b.cast("array<string>"), ","))).alias("boxes"), text(F.col("labels").cast("array<string>")).alias("labels"), F.aggregate("areas", F.lit(0).cast("long"), lambda a, x: a + x).alias("area"))


@query("SELECT raster_id AS tile_idx, CAST(count(label_id) FILTER (label_id % 3 <> 0) AS BIGINT) AS n_masks, count(label_id) AS n_labels, CAST(coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (label_id % 3 <> 0), 0) AS BIGINT) AS area FROM rasters LEFT JOIN labels USING (raster_id) GROUP BY raster_id")
def instance_items(spark, d):
    tiles, own = _item_tables(spark, d)
    s = F.col("shape")
    x, y = s["minx"] % 64, s["miny"] % 64
    runs = R.box_runs(B.box(x, y, x + B.width(s), y + B.height(s)), 128, 128)
    out = datasets.instance_items(tiles, own.withColumn("runs", F.when(F.col("label_id") % 3 != 0, runs)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select("tile_idx", size("masks").alias("n_masks"), size("labels").alias("n_labels"), F.coalesce(F.aggregate("areas", F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long")).alias("area"))


@query("SELECT raster_id AS tile_idx, CAST(coalesce(min_by(label_id % 5, label_id), 0) AS BIGINT) AS label FROM rasters LEFT JOIN labels USING (raster_id) GROUP BY raster_id")
def classification_items(spark, d):
    return datasets.classification_items(*_item_tables(spark, d)).select("tile_idx", *_long("label"))


# ---- pixels


def _bytes(c: Column) -> Column:
    return F.transform(c, lambda v: F.floor(F.least(F.greatest((v.cast("double") + 0.3) * 400, F.lit(0.0)), F.lit(255.0))).cast("int"))


_PIXELS = "px AS (SELECT vec_id AS patch_id, unnest(embedding) AS v FROM embeddings), b AS (SELECT patch_id, floor(least(greatest((CAST(v AS DOUBLE) + 0.3) * 400, 0), 255)) AS p FROM px)"


@query(f"WITH {_PIXELS}\nSELECT patch_id, round(avg(CASE WHEN p IN (0, 255) THEN 1 ELSE 0 END), 6) AS ratio, avg(CASE WHEN p IN (0, 255) THEN 1 ELSE 0 END) < 0.02 AS keep FROM b GROUP BY patch_id")
def pixel_skip_ratio(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), _bytes(F.col("embedding")).alias("band"))
    kept = raster.not_empty(own, ["band"], 0.02).select(F.col("patch_id").alias("kept_id"))
    share = X.empty_share([F.col("band")])
    return own.join(kept, F.col("patch_id") == F.col("kept_id"), "left").select("patch_id", _round(share).alias("ratio"), F.col("kept_id").isNotNull().alias("keep"))


@query(f"WITH {_PIXELS}\nSELECT patch_id, CAST(sum(least(greatest(round_even(CAST(v AS DOUBLE) * 255, 0), 0), 255)) AS BIGINT) AS total FROM px GROUP BY patch_id")
def pixel_uint8(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), X.float_to_byte(F.col("embedding")).alias("band"))
    return own.select("patch_id", F.aggregate("band", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {_PIXELS}\nSELECT patch_id, round(sum(p) / 255, 4) AS total FROM b GROUP BY patch_id")
def pixel_norm(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), X.normalised(_bytes(F.col("embedding"))).alias("band"))
    return own.select("patch_id", _round(F.aggregate("band", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""SELECT label_id, CAST(trunc(l) AS BIGINT) AS "left", CAST(trunc(t) AS BIGINT) AS top, CAST(trunc(r) AS BIGINT) AS "right", CAST(trunc(b) AS BIGINT) AS bottom,
  CAST(greatest(trunc(l), 0) - trunc(l) AS BIGINT) AS pad_left, CAST(trunc(b) - greatest(greatest(trunc(t), 0), least(trunc(b), h)) AS BIGINT) AS pad_bottom
FROM (SELECT label_id, h, ax0 - greatest((ay1 - ay0) - (ax1 - ax0), 0) / 2 AS l, ax1 + greatest((ay1 - ay0) - (ax1 - ax0), 0) / 2 AS r, ay0 - greatest((ax1 - ax0) - (ay1 - ay0), 0) / 2 AS t, ay1 + greatest((ax1 - ax0) - (ay1 - ay0), 0) / 2 AS b
  FROM (SELECT label_id, h, x0 - greatest(3.0, (x1 - x0) * 0.25e0) AS ax0, x1 + greatest(3.0, (x1 - x0) * 0.25e0) AS ax1, y0 - greatest(3.0, (y1 - y0) * 0.25e0) AS ay0, y1 + greatest(3.0, (y1 - y0) * 0.25e0) AS ay1 FROM labels))""")
def box_crop(spark, d):
    return raster.box_crop(T.labels(spark, d), 0.5, 3).select("label_id", *_long("left", "top", "right", "bottom", "pad_left", "pad_bottom"))


@query("""SELECT label_id, CAST(s AS BIGINT) AS tile_size, CAST(co AS BIGINT) AS col_off, CAST(ro AS BIGINT) AS row_off, CAST(greatest(x0, co) - co AS BIGINT) AS minx, CAST(least(y1, ro + s) - ro AS BIGINT) AS maxy
FROM (SELECT *, floor((x0 + x1) / 2 - s / 2) AS co, floor((y0 + y1) / 2 - s / 2) AS ro FROM (SELECT *, floor(greatest(16.0, least(40.0, greatest(x1 - x0, y1 - y0) + 10))) AS s FROM labels))""")
def polygon_tile(spark, d):
    out = raster.polygon_tile(T.labels(spark, d), 40, variable=True, buffer=5, least=16)
    return out.select("label_id", *_long("tile_size", "col_off", "row_off", "clipped.minx", "clipped.maxy"))


# ---- point clouds


@query("""WITH clouds AS (
  SELECT o_orderkey % 5 AS cloud_id, CAST(min((o_orderkey * 31) % 1000) AS DOUBLE) AS x0, CAST(min((o_orderkey * 17) % 900) AS DOUBLE) AS y0, CAST(max((o_orderkey * 31) % 1000) AS DOUBLE) AS x1, CAST(max((o_orderkey * 17) % 900) AS DOUBLE) AS y1
  FROM orders GROUP BY ALL),
counted AS (SELECT *, CAST(ceil((y1 - y0) / 150) AS BIGINT) AS n_rows, CAST(ceil((x1 - x0) / 150) AS BIGINT) AS n_cols FROM clouds)
SELECT cloud_id, i * n_cols + j AS tile_id, x0 + j * 150 AS minx, y0 + i * 150 AS miny, x0 + j * 150 + 200 AS maxx
FROM counted, unnest(range(0, n_rows)) AS a(i), unnest(range(0, n_cols)) AS b(j)""")
def cloud_grid(spark, d):
    own = T.cloud_points(spark, d).withColumn("cloud_id", F.col("point_id") % 5)
    ends = [f(c).cast("double").alias(n) for f, c, n in ((F.min, "x", "minx"), (F.min, "y", "miny"), (F.max, "x", "maxx"), (F.max, "y", "maxy"))]
    return grid.cloud_grid(own.groupBy("cloud_id").agg(*ends), 200.0, 0.25).select("cloud_id", *_long("tile_id"), *[F.col(f"tile.{c}").alias(c) for c in ("minx", "miny", "maxx")])


def _cloud_tiles(spark) -> DataFrame:
    one = spark.range(1).select(F.lit(0).alias("cloud_id"), *[F.lit(v).alias(n) for v, n in ((0.0, "minx"), (0.0, "miny"), (1000.0, "maxx"), (900.0, "maxy"))])
    return grid.cloud_grid(one, 200.0, 0.25)


@query("""SELECT CAST(i * 7 + j AS BIGINT) AS tile_id, count(*) AS n_points FROM range(6) AS a(i), range(7) AS b(j), (SELECT DISTINCT x, y, z FROM cloud) AS c
WHERE x BETWEEN j * 150 AND j * 150 + 200 AND y BETWEEN i * 150 AND i * 150 + 200 GROUP BY ALL""")
def cloud_tile_points(spark, d):
    own = cloud.distinct_points(T.cloud_points(spark, d))
    return cloud.tile_points(own, _cloud_tiles(spark), 200.0).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_points")).select(*_long("tile_id"), "n_points")


@query("""SELECT CAST(floor(x / 40) AS BIGINT) AS vx, CAST(floor(y / 40) AS BIGINT) AS vy, CAST(floor(z / 40) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cloud GROUP BY 1, 2, 3""")
def cloud_voxel(spark, d):
    out = cloud.voxels(T.cloud_points(spark, d), 40, ["x", "y"])
    return out.select("vx", "vy", "vz", "n", _round("x").alias("x"), _round("y").alias("y"))


@query("""SELECT p.point_id, min(label_id) AS label_id FROM points AS p LEFT JOIN labels AS l ON l.raster_id = p.raster_id AND x0 < x AND x < x1 AND y0 < y AND y < y1 GROUP BY p.point_id""")
def cloud_label_points(spark, d):
    own = T.labels(spark, d).select("label_id", "category", "shape", F.col("raster_id").alias("label_raster"))
    return cloud.labelled_points(T.points(spark, d), own, [("raster_id", "label_raster")]).select("point_id", "label_id")


@query("""SELECT p.point_id FROM points AS p WHERE EXISTS (SELECT 1 FROM features AS f WHERE f.raster_id = p.raster_id AND a0 < x AND x < a1 AND b0 < y AND y < b1)""")
def cloud_inside_area(spark, d):
    own = T.features(spark, d).select("area", F.col("raster_id").alias("area_raster"))
    return cloud.inside_area(T.points(spark, d), own, [("raster_id", "area_raster")]).select("point_id")


@query("""SELECT count(*) AS n_tiles, 0.0e0 AS min_x, max(w) * 1.0e0 AS max_x, true AS is_bounded_x, min(h) * 1.0e0 AS min_y, false AS is_bounded_z FROM rasters""")
def cloud_bounds(spark, d):
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    own = T.rasters(spark, d).select(zero.alias("min_x"), F.col("w").cast("double").alias("max_x"), F.col("h").cast("double").alias("min_y"), F.col("h").cast("double").alias("max_y"), none.alias("min_z"), none.alias("max_z"))
    return cloud.bounds(own).select("n_tiles", "min_x", "max_x", "is_bounded_x", "min_y", "is_bounded_z")


@query("""SELECT count(*) AS n, round(count(*) / CAST((max(x) - min(x)) * (max(y) - min(y)) AS DOUBLE), 9) AS density, round(1 / sqrt(count(*) / CAST((max(x) - min(x)) * (max(y) - min(y)) AS DOUBLE)), 6) AS resolution FROM cloud""")
def cloud_density(spark, d):
    return cloud.density(T.cloud_points(spark, d)).select("n", _round("density", 9).alias("density"), _round("resolution").alias("resolution"))


# ---- names


@query("""SELECT raster_id, CAST(tile_id AS BIGINT) AS tile_id, format('supplier_{}_tile_{}_sf0p5_{}_{}_128_128_{}.tif', raster_id, CASE WHEN tile_id % 2 = 0 THEN 'train' ELSE 'noaoi' END, col, row, tile_id) AS name FROM tiles""")
def tile_names(spark, d):
    product = N.product_name(F.concat(F.lit("Supplier--"), F.col("raster_id").cast("string"), F.lit(" ")))
    text = lambda c: F.col(c).cast("string")
    name = N.tile_name(product, N.specifier(scale_factor=0.5), text("col"), text("row"), F.lit("128"), F.lit("128"), text("tile_id"), F.when(F.col("tile_id") % 2 == 0, F.lit("train")))
    return T.tiles(spark, d).select("raster_id", *_long("tile_id"), name.alias("name"))


@query("""SELECT raster_id, 'supplier_' || raster_id AS product, CASE WHEN tile_id % 2 = 0 THEN 'train' END AS aoi, CAST(col AS BIGINT) AS col, CAST(row AS BIGINT) AS row, CAST(tile_id AS BIGINT) AS tile_id, 0.5e0 AS scale_factor FROM tiles""")
def name_parse(spark, d):
    fields = N.parse_tile_name(F.col("name"))
    out = tile_names(spark, d).select("raster_id", *[fields[f].alias(f) for f in ("product", "aoi", "col", "row", "tile_id", "scale_factor")])
    return out.select("raster_id", "product", "aoi", *_long("col", "row", "tile_id"), "scale_factor")


_IN_REGION = "x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (x > x0 + 10 AND x < x1 - 10 AND y > y0 + 10 AND y < y1 - 10)"


@query(f"SELECT point_id, label_id AS region_id FROM cloud JOIN regions ON {_IN_REGION}")
def points_in_holed(spark, d):
    return locate.located(T.cloud_points(spark, d), T.cloud_regions(spark, d))


@query(f"""WITH {T.SQL},
named AS (SELECT point_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, min(label_id) AS label_id FROM (SELECT c.*, label_id FROM cloud AS c LEFT JOIN regions ON {_IN_REGION}) GROUP BY point_id),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY point_id) = 1)
SELECT CAST(i * 7 + j AS BIGINT) AS tile_id, category, count(*) AS n_points, count(DISTINCT label_id) AS n_labels
FROM range(6) AS a(i), range(7) AS b(j), once LEFT JOIN regions USING (label_id) WHERE x BETWEEN j * 150 AND j * 150 + 200 AND y BETWEEN i * 150 AND i * 150 + 200 GROUP BY ALL""")
def cloud_labelled_tiles(spark, d):
    clouds = spark.range(1).select(F.lit(0).alias("cloud_id"), *[F.lit(v).alias(n) for v, n in ((0.0, "minx"), (0.0, "miny"), (1000.0, "maxx"), (900.0, "maxy"))])
    own = pipelines.cloud_tiles(T.cloud_points(spark, d), clouds, 200.0, 0.25, regions=T.cloud_regions(spark, d))
    return own.groupBy("tile_id", "category").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("label_id").alias("n_labels")).select(*_long("tile_id"), "category", "n_points", "n_labels")


@query("""WITH grids AS (
  SELECT s_suppkey AS raster_id, 500.0e0 - 0.25e0 * (400 + 50 * (s_suppkey % 7)) AS y0, 500.0e0 AS y1, 100.0e0 AS x0, 100.0e0 + 0.5e0 * (600 + 100 * (s_suppkey % 5)) AS x1 FROM supplier),
counted AS (SELECT *, CAST(ceil((x1 - x0) / 48) AS BIGINT) AS n_cols, CAST(ceil((y1 - y0) / 48) AS BIGINT) AS n_rows FROM grids)
SELECT raster_id AS cloud_id, i * n_cols + j AS tile_id, x0 + 48 * j AS minx, y0 + 48 * i AS miny, x0 + 48 * j + 64 AS maxx, 0.5e0 AS x_resolution, 0.25e0 AS y_resolution
FROM counted, unnest(range(0, n_rows)) AS a(i), unnest(range(0, n_cols)) AS b(j)""")
def cloud_reference_grid(spark, d):
    own = T.rasters(spark, d).select("raster_id", F.col("w").alias("width"), F.col("h").alias("height"), A.affine(0.5, 0.0, 100.0, 0.0, -0.25, 500.0).alias("transform"))
    out = grid.reference_grid(own, 128, 0.25)
    return out.select("cloud_id", *_long("tile_id"), *[F.col(f"tile.{c}").alias(c) for c in ("minx", "miny", "maxx")], "x_resolution", "y_resolution")


@query("""WITH tiles AS (SELECT DISTINCT 'tile_' || o_custkey AS file_name FROM orders),
listed AS (SELECT 'tile_' || c_custkey AS file_name, min(c_nationkey * 1000 - c_custkey % 7) AS place FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL)
SELECT file_name, row_number() OVER (ORDER BY place, file_name) - 1 AS tile_idx FROM tiles JOIN listed USING (file_name)""")
def tile_order(spark, d):
    name = lambda c: F.concat(F.lit("tile_"), F.col(c)).alias("file_name")
    listed = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(name("c_custkey"), (F.col("c_nationkey") * 1000 - F.col("c_custkey") % 7).alias("place"))
    return coco.ordered_tiles(table(spark, d, "orders").select(name("o_custkey")), listed).select("file_name", *_long("tile_idx"))
