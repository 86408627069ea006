"""COCO documents as tables: categories, annotations, unions, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import polygon as P
from tessella.operators.grid import dense_index


def assert_none(df: DataFrame, message: str) -> None:
    """An error with one example if ``df`` has a row."""
    if found := df.take(1):
        raise ValueError(f"{message}: {found[0]}")


def category_ids(categories: DataFrame) -> DataFrame:
    """``(name, category_id)`` of every name and alias of ``categories(id, name, other_names)``; a name that stands twice is an error."""
    names = F.explode(F.concat(F.array("name"), F.coalesce("other_names", F.array().cast("array<string>"))))
    out = categories.select(names.alias("name"), F.col("id").cast("long").alias("category_id"))
    assert_none(out.groupBy("name").count().where("count > 1"), "category names stand more than once")
    return out


def categories_of(labels: DataFrame, name: str = "category") -> DataFrame:
    """``(id, name, supercategory)``: ids 1..n over the distinct names in order."""
    distinct = labels.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return dense_index(distinct, "name", name="id", start=1).select(F.col("id").cast("long").alias("id"), "name", F.lit("").alias("supercategory"))


def with_category_id(labels: DataFrame, ids: DataFrame, name: str = "category") -> DataFrame:
    """``category_id`` by name, -1 where it is unknown."""
    own = ids.select(F.col("name").alias("known_name"), "category_id")
    return labels.join(own, F.col(name) == F.col("known_name"), "left").drop("known_name").withColumn("category_id", F.coalesce("category_id", F.lit(-1).cast("long")))


def box_to_coco(b: Column) -> Column:
    """Coordinate lists of a box."""
    return P.to_coco(F.array(F.array(B.to_ring(b))))


def coco_bbox(b: Column) -> Column:
    """``[x, y, width, height]``."""
    return F.array(*[c.cast("double") for c in (b["minx"], b["miny"], B.width(b), B.height(b))])


def ordered_tiles(names: DataFrame, order: DataFrame | None = None, start: int = 0) -> DataFrame:
    """``(file_name, tile_idx)`` of the distinct names of ``names(file_name)``, numbered from ``start``.

    With ``order(file_name, place)`` in that order, and only the names that stand in it (in several places: at the
    first); a listed name that no tile has takes no number. Else by name. Null names are left out.
    """
    own = names.where("file_name is not null").select("file_name").distinct()
    if order is None:
        return dense_index(own, "file_name", name="tile_idx", start=start).select("file_name", "tile_idx")
    listed = order.groupBy(F.col("file_name").alias("listed_name")).agg(F.min("place").alias("place"))
    placed = own.join(listed, F.col("file_name") == F.col("listed_name")).select("file_name", "place")
    return dense_index(placed, "place", "file_name", name="tile_idx", start=start).select("file_name", "tile_idx")


def images_of(tiles: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``tiles(file_name, width, height)`` -> ``(id, width, height, file_name)``: ids 1..n by name, or see ``ordered_tiles``."""
    if order is None:
        return dense_index(tiles.select("file_name", "width", "height"), "file_name", name="id", start=1).select("id", "width", "height", "file_name")
    ids = ordered_tiles(tiles, order, 1).withColumnsRenamed({"file_name": "image_name", "tile_idx": "id"})
    return tiles.join(ids, F.col("file_name") == F.col("image_name")).select("id", "width", "height", "file_name")


def annotations_of(labels: DataFrame, images: DataFrame, score: str | None = None, attributes: Column | None = None) -> DataFrame:
    """Annotations of ``labels(file_name, label_id, shape, category_id)``: ids 1..n by image and label.

    A score is written both at the top and among the other attributes.
    """
    own = images.select(F.col("id").alias("image_id"), F.col("file_name").alias("image_name"))
    found = dense_index(labels.join(own, F.col("file_name") == F.col("image_name")), "image_id", "label_id", name="id", start=1)
    extra = attributes if attributes is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    value = F.col(score).cast("double") if score else F.lit(None).cast("double")
    if score:
        extra = F.map_concat(extra, F.create_map(F.lit("score"), value.cast("string")))
    return found.select(
        "id",
        box_to_coco(F.col("shape")).alias("segmentation"),
        F.lit(False).alias("is_rle_format"),
        B.area(F.col("shape")).cast("double").alias("area"),
        F.lit(0).alias("iscrowd"),
        "image_id",
        coco_bbox(F.col("shape")).alias("bbox"),
        "category_id",
        value.alias("score"),
        extra.alias("other_attributes"),
    )


def union_reindexed(images: DataFrame, annotations: DataFrame, categories: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Several documents as one: ``images(doc, id, file_name, width, height)``, ``annotations(doc, image_id, ...)``, ``categories(doc, id, name)``.

    Images of one name merge; a category id with two names is an error. Images without a file
    (of ``files(file_name, path)``, if given), then those without a label, go; the rest get
    dense ids from 0 by name. Returns the tiles and their labels.
    """
    assert_none(categories.groupBy("id").agg(F.count_distinct("name").alias("names")).where("names > 1"), "a category id has several names")
    named = annotations.join(images.select("doc", F.col("id").alias("image_id"), "file_name"), ["doc", "image_id"])
    tiles = images.groupBy("file_name").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    if files is not None:
        assert_none(files.groupBy("file_name").count().where("count > 1"), "file names stand more than once")
        tiles = tiles.join(files, "file_name")
    counts = named.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_labels"))
    tiles = dense_index(tiles.join(counts, "file_name"), "file_name", name="tile_idx")
    return tiles, named.join(tiles.select("file_name", "tile_idx"), "file_name")


def attribute(name: str, annotation: str | None = None, default: Column | None = None) -> Column:
    """An annotation's own column, else its other attribute, else ``default``."""
    parts = [F.col("other_attributes")[F.lit(name)]]
    if annotation:
        parts.insert(0, F.col(annotation).cast("string"))
    return F.coalesce(*parts, *([default.cast("string")] if default is not None else []))


def flattened(images: DataFrame, annotations: DataFrame, categories: DataFrame, attributes: list[str]) -> DataFrame:
    """One row for each annotation with its image's and category's names and the asked-for attributes; unknown ids give null names."""
    own = images.select(F.col("id").alias("of_image"), "file_name")
    names = categories.select(F.col("id").alias("of_category"), F.col("name").alias("category_name"))
    out = annotations.join(own, F.col("image_id") == F.col("of_image"), "left").join(names, F.col("category_id") == F.col("of_category"), "left")
    return out.drop("of_image", "of_category").select("*", *[attribute(a).alias(f"attr_{a}") for a in attributes])


def folds(images: DataFrame, k: int, seed: int = 0, predefined: DataFrame | None = None) -> DataFrame:
    """``(image_id, fold, part)``: k train and valid sets; an image is valid in its own fold, train in the others.

    Images are shuffled by a seeded hash and dealt in turn; or placed by ``predefined(image_id, own_fold)``,
    where a missing image is an error.
    """
    if predefined is None:
        dealt = dense_index(images.select(F.col("id").alias("image_id"), F.xxhash64(F.lit(seed), "id").alias("mixed")), "mixed", "image_id", name="place")
        own = dealt.select("image_id", (F.col("place") % k).cast("int").alias("own_fold"))
    else:
        own = images.select(F.col("id").alias("image_id")).join(predefined, "image_id", "left")
        own = own.withColumn("own_fold", F.coalesce("own_fold", F.raise_error(F.concat(F.lit("no fold for image "), F.col("image_id").cast("string"))).cast("int")))
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return own.select("image_id", "own_fold", fold.alias("fold")).select("image_id", "fold", F.when(F.col("fold") == F.col("own_fold"), "valid").otherwise("train").alias("part"))
