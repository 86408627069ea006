"""Composite jobs: from rasters, labels and areas to tiles and annotation sets, each a chain of DataFrame operators.

Where an operator needs a written table, a count or a check, that job runs while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import names as N
from tessella.functions import polygon as P
from tessella.functions.kernels import runs_polygon
from tessella.operators import aoi as A
from tessella.operators import cloud, coco, grid, labels, locate, nms, raster
from tessella.operators.coords import extents, to_coordinates
from tessella.session import written
from tessella.sources.coco_files import check_document, read_coco, segmentation_shape, write_coco


@dataclass(frozen=True)
class Tiling:
    """How rasters are cut: ``areas`` generates a split; without it ``features`` of given areas, or one area ``all``."""

    size: int
    overlap: float = 0.0
    areas: list[A.Aoi] = field(default_factory=list)
    kind: str = "band"
    empty_threshold: float = 1.0  # under 1 pixels are looked at; see ``raster.not_empty``
    scale_factor: float | None = None
    ground_resolution: float | None = None


def tiles(rasters: DataFrame, how: Tiling, features: DataFrame | None = None, global_area: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``(raster_id, tile_id, row, col, tile, aoi, file_name)`` of ``rasters(raster_id, product, w, h)``.

    Tiles are cut, restricted to the global area and to tiles with labels (``labelled``, pairs), and
    then split, so quotas are of the tiles that remain. Given areas yield a tile for each area it meets.
    """
    own = grid.tile_grid(rasters, how.size, how.overlap, checked=how.empty_threshold < 1)
    if global_area is not None:
        own = A.restricted(own, global_area, "tile")
    if labelled is not None:
        own = labels.labeled_tiles(own, labelled)
    step = grid.step_of(how.size, how.overlap)
    if how.areas:
        split = A.band if how.kind == "band" else A.corner
        own = A.renamed(split(own, how.areas, step), how.areas)
    elif features is not None:
        met = A.package_tiles(own, features)
        own = own.join(met, ["raster_id", "tile_id"]).withColumn("tile_id", F.col("new_tile_id")).drop("new_tile_id")
    else:
        own = own.withColumn("aoi", F.lit("all"))
    return named(own, rasters, how)


def named(own: DataFrame, rasters: DataFrame, how: Tiling) -> DataFrame:
    spec = N.specifier(how.scale_factor, how.ground_resolution)
    text = lambda c: c.cast("string")
    t = F.col("tile")
    name = N.tile_name(N.product_name(F.col("product")), spec, text(F.col("col")), text(F.col("row")), text(B.width(t)), text(B.height(t)), text(F.col("tile_id")), F.col("aoi"))
    return own.join(rasters.select("raster_id", "product"), "raster_id").withColumn("file_name", name).drop("product")


@dataclass
class Document:
    """Tables of an annotation set; ``write`` makes one COCO file for each area."""

    tiles: DataFrame
    labels: DataFrame
    categories: DataFrame

    def of_area(self, name: str, score: str | None = None) -> tuple[DataFrame, DataFrame]:
        own = self.tiles.where(F.col("aoi") == name)
        images = coco.images_of(own.select("file_name", B.width(F.col("tile")).cast("int").alias("width"), B.height(F.col("tile")).cast("int").alias("height")))
        return images, coco.annotations_of(self.labels.where(F.col("aoi") == name), images, score)

    def write(self, path: str, product: str, specifier: str, areas: list[str], check: bool = True) -> list[str]:
        out = []
        for name in areas:
            images, annotations = self.of_area(name)
            if check:
                check_document(images, annotations, self.categories)
            target = f"{path}/{product}_coco_{specifier}_{name}.json"
            write_coco(images, annotations, self.categories, target)
            out.append(target)
        return out


def _with_categories(own: DataFrame, categories: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    known = coco.categories_of(own) if categories is None else categories
    if "other_names" not in known.columns:
        known = known.withColumn("other_names", F.array().cast("array<string>"))
    return coco.with_category_id(own, coco.category_ids(known)), known.drop("other_names")


def labeled_dataset(rasters: DataFrame, label_rows: DataFrame, how: Tiling, ratio: tuple[int, int] = (9, 10), features: DataFrame | None = None, global_area: DataFrame | None = None, categories: DataFrame | None = None, drop_unlabeled: bool = True) -> Document:
    """Tiles with the labels that lie in them to more than ``ratio``, in tile pixels.

    ``label_rows(raster_id, label_id, shape, category)``. With given areas a label must also keep
    more than the ratio of its clipped ground inside the tile's area.
    """
    clean = labels.cleaned(label_rows, rasters)
    first = labels.tile_overlap(grid.tile_grid(rasters, how.size, how.overlap, checked=how.empty_threshold < 1), clean, ratio)
    own = tiles(rasters, how, features, global_area, first if drop_unlabeled else None)
    pairs = labels.tile_overlap(own, clean, ratio)
    if features is not None and not how.areas:
        pairs = labels.second_pass(pairs, features, ratio[0] / ratio[1]).drop("area", "ratio")
    inside = labels.in_tile_pixels(pairs).join(clean.select("label_id", "category"), "label_id")
    if drop_unlabeled:
        own = labels.labeled_tiles(own, inside)
    annotated, known = _with_categories(inside, categories)
    return Document(own, annotated, known)


def additional_dataset(document: Document, label_rows: DataFrame, ratio: tuple[int, int] = (9, 10), categories: DataFrame | None = None) -> Document:
    """The same tiles, all of them, with other labels."""
    inside = labels.in_tile_pixels(labels.tile_overlap(document.tiles, label_rows, ratio)).join(label_rows.select("label_id", "category"), "label_id")
    annotated, known = _with_categories(inside, categories)
    return Document(document.tiles, annotated, known)


def polygon_dataset(rasters: DataFrame, label_rows: DataFrame, size: int, features: DataFrame, least_ratio: float = 0.9, variable: bool = False, buffer: int = 0, least: int | None = None, categories: DataFrame | None = None, how: Tiling | None = None) -> Document:
    """A tile for each label: those whose best area covers ``least_ratio`` of them, on square windows centred on them."""
    clean = labels.cleaned(label_rows, rasters)
    best = A.package_polygons(clean, features).select("label_id", "aoi")
    covered = A.covered_ratio(clean, features, least_ratio).select("label_id", "aoi")
    kept = clean.join(best, "label_id").join(covered, ["label_id", "aoi"], "left_semi")
    cut = raster.polygon_tile(kept, size, variable, buffer, least)
    window = B.box("col_off", "row_off", F.col("col_off") + F.col("tile_size"), F.col("row_off") + F.col("tile_size"))
    own = cut.select("raster_id", F.col("label_id").alias("tile_id"), F.col("row_off").alias("row"), F.col("col_off").alias("col"), window.alias("tile"), "aoi", "label_id", F.col("clipped").alias("shape"), "category")
    own = named(own, rasters, how or Tiling(size))
    annotated, known = _with_categories(own.select("label_id", "shape", "category", "aoi", "file_name"), categories)
    return Document(own.drop("label_id", "shape", "category"), annotated, known)


def coco_to_shapes(spark: SparkSession, paths: str | list[str], tiles: DataFrame | None = None, attributes: list[str] | None = None, fold: str | None = None, target: int | None = None) -> DataFrame:
    """Annotations of COCO files as rows with category and attributes, in pixels or, with ``tiles(file_name, transform)``, in coordinates."""
    images, annotations, categories = read_coco(spark, paths, fold)
    own = segmentation_shape(annotations)
    traced = runs_polygon(F.col("runs"), F.col("mask_height"), F.lit(1.0))
    own = own.withColumn("shape", F.coalesce("shape", F.when(F.col("runs").isNotNull(), P.of_coco(traced))))
    # ids are only unique inside a document
    key = lambda df, c: df.withColumn(c, F.struct("doc", c))
    rows = coco.flattened(key(images, "id").select("id", "file_name"), key(key(own, "image_id"), "category_id"), key(categories, "id").select("id", "name"), attributes or [])
    rows = rows.withColumn("image_id", F.col("image_id.image_id")).withColumn("category_id", F.col("category_id.category_id"))
    return rows if tiles is None else to_coordinates(rows, tiles, "file_name", target=target)


def aggregate_coco(spark: SparkSession, paths: str | list[str], tiles: DataFrame, weights: dict[str, float] | None = None, blend: str = "weighted_geometric_mean", score_threshold: float = 0.1, nms_threshold: tuple[int, int] = (8, 10), edge_band: float | None = 0.05, disambiguate: float | None = None, keep_ratio: float = 0.5) -> DataFrame:
    """Predictions of tile COCO files as one set in the coordinates of ``tiles(file_name, width, height, transform)``.

    Scores come from the annotation or its other attributes (0 where missing). Greedy suppression by polygon
    IoU, or with ``disambiguate`` suppression by covered share and cutting.
    """
    weights = weights or {"score": 1.0}
    rows = coco_to_shapes(spark, paths, tiles, [w for w in weights if w != "score"])
    for w in weights:
        value = F.col("score") if w == "score" else F.col(f"attr_{w}").cast("double")
        rows = rows.withColumn(f"s_{w}", F.coalesce(value, F.lit(0.0)))
    largest = P.largest_part(F.col("shape"))
    rows = rows.withColumn("flat", P.to_coco(largest)[0]).where(F.col("flat").isNotNull())
    rows = grid.dense_index(rows.withColumn("shape", P.bounds(largest)), "file_name", "doc", "id", name="pred_id")
    framed = extents(tiles).select(F.col("file_name").alias("tile_id"), "extent")
    own = rows.withColumn("tile_id", F.col("file_name"))
    own = nms.off_edges(own, framed, edge_band) if edge_band else own
    own = written(nms.over_threshold(nms.scored(own, {f"s_{w}": v for w, v in weights.items()}, blend), score_threshold), "scored")
    cell = 64.0 * _pixel(tiles)
    if disambiguate is not None:
        return nms.ioa_disambiguated(own, disambiguate, keep_ratio, cell=cell, flat="flat").join(own.drop("shape", "flat"), "pred_id")
    return nms.greedy_nms(own, *nms_threshold, cell=cell, flat="flat")


def _pixel(tiles: DataFrame) -> float:
    """Size of a pixel of some tile, to choose the cells of a join by."""
    first = tiles.select(F.abs(F.col("transform.a"))).first()
    return first[0] if first and first[0] else 1.0


def from_shapes(rows: DataFrame, tiles: DataFrame | None = None, order: DataFrame | None = None, weights: dict[str, float] | None = None, blend: str = "weighted_geometric_mean", score_threshold: float = 0.1, nms_threshold: tuple[int, int] = (8, 10), edge_band: float | None = 0.05) -> DataFrame:
    """Predictions ``rows(file_name, flat, ...)`` as one set: ``aggregate_coco`` for shapes that are rows already.

    ``flat``: polygon coordinates; the columns that ``weights`` names are the scores (missing: 0). With
    ``tiles(file_name, width, height, transform)`` shapes are in tile pixels and get the tiles' coordinates, without in coordinates
    already, and no edge band is looked at. ``tile_idx`` numbers the tiles, see ``coco.ordered_tiles``; rows of tiles left out go.
    """
    weights = weights or {"score": 1.0}
    ids = coco.ordered_tiles(rows, order).withColumnRenamed("file_name", "of_file")
    own = rows.join(ids, F.col("file_name") == F.col("of_file")).drop("of_file").where(F.size("flat") >= 6)
    own = own.withColumns({f"s_{w}": F.coalesce(F.col(w).cast("double"), F.lit(0.0)) for w in weights}).withColumn("shape", P.of_coco(F.array("flat")))
    if tiles is not None:
        own = to_coordinates(own, tiles, "file_name")
    own = own.withColumn("flat", P.to_coco(F.col("shape"))[0]).withColumn("shape", P.bounds(F.col("shape")))
    own = grid.dense_index(own, "tile_idx", F.hash("flat"), F.xxhash64("flat"), name="pred_id")
    if tiles is not None and edge_band:
        framed = extents(tiles).select(F.col("file_name").alias("tile_id"), "extent")
        own = nms.off_edges(own.withColumn("tile_id", F.col("file_name")), framed, edge_band).drop("tile_id")
    own = written(nms.over_threshold(nms.scored(own, {f"s_{w}": v for w, v in weights.items()}, blend), score_threshold), "scored")
    return nms.greedy_nms(own, *nms_threshold, cell=None, flat="flat")


def cloud_tiles(points: DataFrame, clouds: DataFrame, side: float, overlap: float = 0.0, areas: DataFrame | None = None, voxel: float | None = None, most: int = 5_000, force: bool = False, regions: DataFrame | None = None) -> DataFrame:
    """Distinct (or voxel-averaged) points with their tiles and areas ``areas(aoi, area)``; points outside of theirs go.

    With ``regions(label_id, category, rings)`` each point also gets the label that it lies in.
    """
    own = grid.within_limit(grid.cloud_grid(clouds, side, overlap), most, force)
    if voxel:
        thin = cloud.voxels(points, voxel, ["x", "y", "z"])
        points = thin.select(F.xxhash64("vx", "vy", "vz").alias("point_id"), "x", "y", "z")
    points = cloud.distinct_points(points)
    if regions is not None:
        points = locate.labelled(points, regions)
    dealt = cloud.tile_points(points, own, side)
    if areas is None:
        return dealt.withColumn("aoi", F.lit(None).cast("string"))
    best = cloud.best_areas(own.select("tile_id", "tile"), areas, side)
    return cloud.inside_area(dealt.join(best, "tile_id"), areas.withColumnRenamed("aoi", "of_aoi"), [("aoi", "of_aoi")], side)
