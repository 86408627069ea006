"""Areas of interest: splits of the tiles or polygons of a raster."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions.rectilinear import Cells
from tessella.operators.grid import cell_of
from tessella.operators.spatial import cell_join
from tessella.session import written


@dataclass(frozen=True)
class Aoi:
    """A generated area: its share of the tiles, its place in the order and the name it is saved under."""

    name: str
    percentage: float
    position: int | None = None
    actual_name: str | None = None
    priority: bool = False


def check_aois(aois: list[Aoi], kind: str = "band") -> None:
    """Names of letters and digits, one priority area at most, shares above 0 that sum to 1 at most, positions 1..n or none."""
    if kind not in ("band", "corner"):
        raise ValueError(f"unknown kind of area: {kind}")
    if not aois or len({a.name for a in aois}) != len(aois):
        raise ValueError("areas need different names")
    for a in aois:
        if not all(n.isalnum() for n in (a.name, a.actual_name or a.name)):
            raise ValueError(f"names take letters and digits only: {a.name}, {a.actual_name}")
        if not 0 < a.percentage <= 1:
            raise ValueError(f"the share of {a.name} must be above 0 and at most 1")
    if sum(a.priority for a in aois) > 1:
        raise ValueError("only one area can have priority")
    if sum(a.percentage for a in aois) > 1 + 1e-9:
        raise ValueError("shares sum to more than 1")
    positions = [a.position for a in aois if a.position is not None]
    if positions and sorted(positions) != list(range(1, len(aois) + 1)):
        raise ValueError("positions must be 1 to n, or none at all")
    if kind == "corner" and len(aois) > 4:
        raise ValueError("there are four corners only")


def _ordered(aois: list[Aoi]) -> list[Aoi]:
    return sorted(aois, key=lambda a: a.position or 0)


def _quota_columns(n: Column, aois: list[Aoi]) -> dict[str, Column]:
    """Largest-remainder shares of ``n``; ties go to the larger share, then to the earlier area."""
    ranked = sorted(aois, key=lambda a: -a.percentage)
    total = sum(a.percentage for a in aois)
    exact = [F.lit(a.percentage / total) * n for a in ranked]
    floors = [F.floor(e) for e in exact]
    left = n - reduce(Column.__add__, floors)
    rest = [e - f for e, f in zip(exact, floors, strict=True)]
    out = {}
    for i, a in enumerate(ranked):
        ahead = [(rest[j] >= rest[i] if j < i else rest[j] > rest[i]).cast("int") for j in range(len(ranked)) if j != i]
        place = reduce(Column.__add__, ahead, F.lit(0))
        few = F.when(F.lit(i) < n, 1).otherwise(0)
        out[a.name] = F.when(n < len(aois), few).otherwise(floors[i] + (place < left).cast("int")).cast("long")
    return out


def quotas(counts: DataFrame, aois: list[Aoi]) -> DataFrame:
    """``counts(raster_id, n)`` -> ``(raster_id, aoi, quota)``: tiles of each area; they sum to n."""
    check_aois(aois)
    by = _quota_columns(F.col("n"), aois)
    rows = F.array(*[F.struct(F.lit(k).alias("aoi"), v.alias("quota")) for k, v in by.items()])
    return counts.select("raster_id", F.inline(rows))


def _grouped_rank(tiles: DataFrame, outer: str, *inner) -> DataFrame:
    """``rank`` from 0 by ``outer`` and then ``inner`` in each raster, and the raster's count ``n``.

    From the counts of the outer groups and ranks inside of them: no window holds more than
    an outer group (a grid column, a front) of tiles.
    """
    groups = tiles.groupBy("raster_id", outer).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("raster_id")
    before = F.coalesce(F.sum("size").over(whole.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("raster_id").alias("of_raster"), F.col(outer).alias("of_group"), before.alias("before"), F.sum("size").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("raster_id", outer).orderBy(*inner)) - 1
    out = tiles.withColumn("inside", inside).join(groups, (F.col("raster_id") == F.col("of_raster")) & (F.col(outer) == F.col("of_group")))
    return out.withColumn("rank", F.col("before") + F.col("inside")).drop("inside", "before", "of_raster", "of_group")


def band(tiles: DataFrame, aois: list[Aoi], step: int) -> DataFrame:
    """``tiles(raster_id, tile_id, row, col, ...)`` with ``aoi``: areas in order of position fill the grid column by column.

    Quotas are of the tiles given; every tile gets an area, as shares are normalised.
    """
    check_aois(aois)
    row, col = cell_of(F.col("row"), F.col("col"), step)
    ranked = _grouped_rank(tiles.withColumn("grid_row", row).withColumn("grid_col", col), "grid_col", "grid_row", "tile_id")
    by = _quota_columns(F.col("n"), aois)
    aoi, until = F.lit(None).cast("string"), F.lit(0).cast("long")
    for a in _ordered(aois):
        until = until + by[a.name]
        aoi = F.coalesce(aoi, F.when(F.col("rank") < until, F.lit(a.name)))
    return ranked.select(*tiles.columns, aoi.alias("aoi"))


def corner(tiles: DataFrame, aois: list[Aoi], step: int) -> DataFrame:
    """As ``band``, but each area grows L by L from a corner of its own: upper left, upper right, lower left, lower right."""
    check_aois(aois, "corner")
    row, col = cell_of(F.col("row"), F.col("col"), step)
    sizes = tiles.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.max(row).alias("last_row"), F.max(col).alias("last_col"))
    rest = tiles.withColumn("grid_row", row).withColumn("grid_col", col).join(sizes, "raster_id")
    by = _quota_columns(F.col("n_tiles"), aois)
    out = []
    for i, a in enumerate(_ordered(aois)):
        at = (a.position or i + 1) - 1
        r = F.col("last_row") - F.col("grid_row") if at >= 2 else F.col("grid_row")
        c = F.col("last_col") - F.col("grid_col") if at % 2 else F.col("grid_col")
        fronts = rest.withColumn("front", F.greatest(r, c))
        placed = written(_grouped_rank(fronts, "front", F.when(r > c, 0).otherwise(1), F.least(r, c), "tile_id"), "fronts")
        out.append(placed.where(F.col("rank") < by[a.name]).withColumn("aoi", F.lit(a.name)))
        rest = placed.where(F.col("rank") >= by[a.name]).drop("n", "rank", "front")
    return reduce(DataFrame.unionByName, out).select(*tiles.columns, "aoi")


def _redistributed(group: pd.DataFrame, shares: dict[str, float], priority: str | None) -> pd.DataFrame:
    areas: dict[str, Cells] = {}
    for r in group.itertuples():
        own = Cells.of_box(r.minx, r.miny, r.maxx, r.maxy)
        areas[r.aoi] = Cells(areas[r.aoi].boxes + own.minus(areas[r.aoi]).boxes) if r.aoi in areas else own
    names = sorted(areas, key=lambda k: (areas[k].area, k))
    for i, one in enumerate(names):
        for other in names[:i]:
            for a in areas[one].common(areas[other]).boxes:
                share = 1.0 if one == priority else 0.0 if other == priority else shares[one] / (shares[one] + shares[other])
                middle = a[0] + (a[2] - a[0]) * share  # the left part stays with the first, the right with the second
                areas[other] = areas[other].minus(Cells([(a[0], a[1], middle, a[3])]))
                areas[one] = areas[one].minus(Cells([(middle, a[1], a[2], a[3])]))
    rows = [(group.raster_id.iloc[0], k, *b) for k in names for b in areas[k].boxes]
    return pd.DataFrame(rows, columns=["raster_id", "aoi", "minx", "miny", "maxx", "maxy"])


def redistributed(features: DataFrame, aois: list[Aoi]) -> DataFrame:
    """Features ``(raster_id, aoi, area)`` made disjoint between areas.

    Where two areas overlap the one with priority keeps all; else each part is cut in the
    ratio of their shares. A raster's areas are few boxes and form one group.
    """
    flat = features.select("raster_id", "aoi", *[F.col(f"area.{c}").cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    shares, priority = {a.name: a.percentage for a in aois}, next((a.name for a in aois if a.priority), None)
    kind = features.schema["raster_id"].dataType.simpleString()
    out = flat.groupBy("raster_id").applyInPandas(partial(_redistributed, shares=shares, priority=priority), f"raster_id {kind}, aoi string, minx double, miny double, maxx double, maxy double")
    return out.select("raster_id", "aoi", B.box("minx", "miny", "maxx", "maxy").alias("area"))


def renamed(df: DataFrame, aois: list[Aoi]) -> DataFrame:
    """``aoi`` under the actual names, which may merge several areas."""
    names = {a.name: a.actual_name or a.name for a in aois}
    return df.withColumn("aoi", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("aoi")])


def package_tiles(tiles: DataFrame, features: DataFrame, cell: float = 256.0) -> DataFrame:
    """Tiles of each given area: ``features(raster_id, aoi, area)`` -> ``(raster_id, tile_id, aoi, new_tile_id)``.

    A tile comes once for each area that it shares ground with, however many features of it;
    new ids go on from the raster's largest, by area and then tile.
    """
    own = features.select(F.col("raster_id").alias("of_raster"), "aoi", "area")
    pairs = cell_join(tiles.select("raster_id", "tile_id", "tile"), own, "tile", "area", [("raster_id", "of_raster")], cell).select("raster_id", "tile_id", "aoi").distinct()
    top = tiles.groupBy("raster_id").agg(F.max("tile_id").alias("top")).withColumnRenamed("raster_id", "top_raster")
    counts = pairs.groupBy("raster_id", "aoi").agg(F.count(F.lit(1)).alias("in_aoi"))
    before = F.coalesce(F.sum("in_aoi").over(Window.partitionBy("raster_id").orderBy("aoi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("raster_id").alias("n_raster"), F.col("aoi").alias("n_aoi"), before.alias("before"))
    numbered = pairs.withColumn("place", F.row_number().over(Window.partitionBy("raster_id", "aoi").orderBy("tile_id")))
    out = numbered.join(counts, (F.col("raster_id") == F.col("n_raster")) & (F.col("aoi") == F.col("n_aoi"))).join(top.hint("merge"), F.col("raster_id") == F.col("top_raster"))
    return out.select("raster_id", "tile_id", "aoi", (F.col("top") + F.col("before") + F.col("place")).alias("new_tile_id"))


def package_polygons(labels: DataFrame, features: DataFrame, cell: float = 256.0) -> DataFrame:
    """``(label_id, aoi, common)``: for each label the area whose feature shares most ground, ties to the least name."""
    own = features.select(F.col("raster_id").alias("of_raster"), "aoi", "area")
    pairs = cell_join(labels.select("raster_id", "label_id", "shape"), own, "shape", "area", [("raster_id", "of_raster")], cell)
    pairs = pairs.withColumn("common", B.intersection_area(F.col("shape"), F.col("area")))
    best = F.min(F.struct((-F.col("common")).alias("less"), "aoi"))
    return pairs.groupBy("label_id").agg(best.alias("best")).select("label_id", "best.aoi", (-F.col("best.less")).alias("common"))


def restricted(df: DataFrame, global_aoi: DataFrame, box: str, cell: float = 256.0, key: str = "tile_id") -> DataFrame:
    """Rows of ``df`` that share ground with the global area ``(raster_id, area)``; only keys and boxes are shuffled to find them."""
    own = global_aoi.select(F.col("raster_id").alias("of_raster"), "area")
    met = cell_join(df.select("raster_id", key, box), own, box, "area", [("raster_id", "of_raster")], cell).select(F.col("raster_id").alias("met_raster"), F.col(key).alias("met_key"))
    return df.join(met, (F.col("raster_id") == F.col("met_raster")) & (F.col(key) == F.col("met_key")), "left_semi")


def covered_ratio(labels: DataFrame, features: DataFrame, least: float, cell: float = 256.0) -> DataFrame:
    """``(label_id, aoi, ratio)``: the share of each label that an area's features cover, kept from ``least`` less 1e-9 on.

    Ground under several features of an area counts once. A label without extent counts as wholly inside.
    """
    own = features.select(F.col("raster_id").alias("of_raster"), "aoi", "area")
    pairs = cell_join(labels.select("raster_id", "label_id", "shape"), own, "shape", "area", [("raster_id", "of_raster")], cell, B.intersects)
    met = pairs.groupBy("label_id", "aoi").agg(F.first(B.area(F.col("shape"))).alias("extent"), F.collect_set(B.intersection(F.col("shape"), F.col("area"))).alias("common"))
    ratio = F.coalesce(F.try_divide(B.union_area(F.col("common")), F.col("extent")), F.lit(1.0))
    return met.select("label_id", "aoi", ratio.alias("ratio")).where(F.col("ratio") >= least - 1e-9)


def masked_pixels(tiles: DataFrame, features: DataFrame, cell: float = 256.0) -> DataFrame:
    """``(raster_id, tile_id, aoi, masked)``: pixels of each tile outside its area's (whole-pixel) features, which may overlap."""
    own = features.select(F.col("raster_id").alias("of_raster"), "aoi", "area")
    pairs = cell_join(tiles.select("raster_id", "tile_id", "tile"), own, "tile", "area", [("raster_id", "of_raster")], cell)
    common = B.intersection(F.col("tile"), F.col("area"))
    kind = pairs.select(F.sum(B.area(common)).alias("seen")).schema["seen"].dataType
    met = pairs.groupBy("raster_id", "tile_id", "aoi").agg(F.first(B.area(F.col("tile"))).alias("extent"), F.collect_set(common).alias("common"))
    return met.select("raster_id", "tile_id", "aoi", (F.col("extent") - B.union_area(F.col("common")).cast(kind)).alias("masked"))


def label_matrix(tiles: DataFrame, step: int) -> DataFrame:
    """``(raster_id, grid_row, grid_col, aoi)``: what a picture of the split would show."""
    row, col = cell_of(F.col("row"), F.col("col"), step)
    return tiles.select("raster_id", row.alias("grid_row"), col.alias("grid_col"), "aoi")
