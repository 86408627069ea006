"""Training items: one row for each tile, its labels in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B
from tessella.functions import rle as R


def padded(b: Column, width: Column, height: Column, by: float) -> Column:
    """A box grown by a share of its sides on every side, clamped to the image and truncated."""
    x, y = B.width(b) * by, B.height(b) * by
    return B.box(
        F.floor(F.greatest(b["minx"] - x, F.lit(0.0))).cast("int"),
        F.floor(F.greatest(b["miny"] - y, F.lit(0.0))).cast("int"),
        F.floor(F.least(b["maxx"] + x, width.cast("double"))).cast("int"),
        F.floor(F.least(b["maxy"] + y, height.cast("double"))).cast("int"),
    )


def category_or(category: Column, force: int | None = None) -> Column:
    """A missing category is 0; ``force`` gives every label that class."""
    return F.lit(force).cast("long") if force is not None else F.coalesce(category, F.lit(0).cast("long"))


def detection_items(tiles: DataFrame, labels: DataFrame, padding: float = 0.0, force: int | None = None) -> DataFrame:
    """``tiles(tile_idx, width, height)``, ``labels(tile_idx, label_id, shape, category_id)`` -> boxes, labels and areas of each tile in label order."""
    own = labels.join(tiles.select("tile_idx", "width", "height"), "tile_idx")
    b = padded(F.col("shape"), F.col("width"), F.col("height"), padding)
    own = own.select("tile_idx", "label_id", b.alias("b"), category_or(F.col("category_id"), force).alias("label"))
    row = F.struct("label_id", F.array(*[F.col(f"b.{c}") for c in ("minx", "miny", "maxx", "maxy")]).alias("box"), "label", B.area(F.col("b")).cast("long").alias("area"))
    items = own.groupBy("tile_idx").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return items.select("tile_idx", F.col("rows.box").alias("boxes"), F.col("rows.label").alias("labels"), F.col("rows.area").alias("areas"), F.transform("rows", lambda r: F.lit(0)).alias("iscrowd"))


def segmentation_items(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``(tile_idx, masks, labels)``: runs of the labels that have some, but the classes of all labels, in label order."""
    row = F.struct("label_id", "runs", category_or(F.col("category_id")).alias("label"))
    items = labels.groupBy("tile_idx").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    out = tiles.select("tile_idx").join(items, "tile_idx", "left")
    return out.select("tile_idx", F.array_compact("rows.runs").alias("masks"), F.col("rows.label").alias("labels"))


def instance_items(tiles: DataFrame, labels: DataFrame, padding: float = 0.0) -> DataFrame:
    """``(tile_idx, boxes, masks, labels, areas)``: areas are those of the masks."""
    found = detection_items(tiles, labels, padding).select("tile_idx", "boxes")
    masks = segmentation_items(tiles, labels)
    return masks.join(found, "tile_idx", "left").withColumn("areas", F.transform("masks", R.area))


def cloud_items(points: DataFrame, label: str = "semantic_label") -> DataFrame:
    """``(tile_id, positions, labels)`` of labelled cloud tiles, points in order of their id; a point without label has NaN."""
    value = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))
    rows = F.sort_array(F.collect_list(F.struct("point_id", F.array(*[F.col(c).cast("float") for c in "xyz"]).alias("p"), value.alias("v"))))
    out = points.groupBy("tile_id").agg(rows.alias("rows"))
    return out.select("tile_id", F.col("rows.p").alias("positions"), F.col("rows.v").alias("labels"))


def classification_items(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``(tile_idx, label)``: the first label's category; none, null or -1 is 0."""
    first = labels.groupBy("tile_idx").agg(F.min(F.struct("label_id", "category_id")).alias("first"))
    out = tiles.select("tile_idx").join(first, "tile_idx", "left")
    return out.select("tile_idx", F.greatest(F.coalesce("first.category_id", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("label"))


class TileDataset:
    """Tiles in order of their dense index: length, single items, iteration and a per-item hook."""

    def __init__(self, items: DataFrame, transform=None):
        if "tile_idx" not in items.columns:
            raise ValueError("items need a tile_idx")
        self.items, self.transform = items, transform

    def __len__(self) -> int:
        return self.items.count()

    def __getitem__(self, idx: int):
        found = self.transformed().where(F.col("tile_idx") == idx).take(1)
        if not found:
            raise IndexError(idx)
        return found[0]

    def __iter__(self) -> Iterator:
        return self.transformed().orderBy("tile_idx").toLocalIterator(prefetchPartitions=True)

    def transformed(self) -> DataFrame:
        """Items after the user's ``transform(dict) -> dict``, which keeps the columns."""
        if self.transform is None:
            return self.items
        change = self.transform

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([change(r) for r in batch.to_dict("records")], columns=batch.columns)

        return self.items.mapInPandas(over, self.items.schema)
