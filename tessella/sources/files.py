"""Tile, point and raster files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names as N
from tessella.operators.coco import assert_none


def find_tiles(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("tif",), fold: str | None = None, unique: bool = True) -> DataFrame:
    """``(path, file_name)`` below ``root``; with a fold only files in ``tiles/<fold>``. A name that stands twice is an error."""
    glob = "*.{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    out = found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))
    if fold is not None:
        out = out.where(F.col("path").contains(f"/tiles/{fold}/"))
    if unique:
        assert_none(out.groupBy("file_name").count().where("count > 1"), "a tile name stands more than once")
    return out


def tiles_of_names(tiles: DataFrame) -> DataFrame:
    """Fields read from the file names of ``find_tiles``."""
    fields = N.parse_tile_name(F.col("file_name"))
    return tiles.select("*", *[c.alias(k) for k, c in fields.items()])


def read_point_tiles_csv(spark: SparkSession, root: str, fold: str | None = None) -> DataFrame:
    """``(tile_name, min_x, max_x, min_y, max_y, crs)`` of every CSV below ``root``, rows whose name contains the fold."""
    schema = "tile_name string, min_x double, max_x double, min_y double, max_y double, crs string"
    out = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root, header=True, schema=schema)
    return out if fold is None else out.where(F.col("tile_name").contains(fold))


def write_point_tiles_csv(tiles: DataFrame, path: str) -> None:
    tiles.select("tile_name", "min_x", "max_x", "min_y", "max_y", "crs").write.mode("overwrite").csv(path, header=True)


def write_point_tiles(points: DataFrame, path: str) -> None:
    """Points by area and tile; tiles without an area go under ``noaoi``, tiles without a point have no file."""
    points.withColumn("aoi", F.coalesce("aoi", F.lit("noaoi"))).write.mode("overwrite").partitionBy("aoi", "tile_id").parquet(path)


# ---- rasters: NPY arrays of (bands, height, width) or (height, width), cut into blocks


def _block_batches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    names = ["path", "band", "block_row", "block_col", "pixels"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.load(io.BytesIO(content), allow_pickle=False)
            data = data[None] if data.ndim == 2 else data
            for b, image in enumerate(data):
                for i in range(0, image.shape[0], block):
                    rows = [(path, b, i // block, j // block, _whole(image[i : i + block, j : j + block], block)) for j in range(0, image.shape[1], block)]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)


def _whole(part: np.ndarray, block: int) -> list[float]:
    out = np.zeros((block, block))
    out[: part.shape[0], : part.shape[1]] = part
    return out.ravel().tolist()


def read_raster_blocks(spark: SparkSession, paths: str | list[str], block: int = 256) -> DataFrame:
    """``(path, band, block_row, block_col, pixels)`` of NPY rasters: square blocks, row by row, blanks as 0."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(partial(_block_batches, block=block), "path string, band int, block_row long, block_col long, pixels array<double>")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile pixels as a table by area; the block table is the engine's tile format."""
    tiles.write.mode("overwrite").partitionBy("aoi").parquet(path)


# ---- LAS point clouds


def _las_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "point_id", "x", "y", "z", "intensity", "classification"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = las_points(content)
            for a in range(0, len(points["x"]), 100_000):
                own = {k: v[a : a + 100_000] for k, v in points.items()}
                n = len(own["x"])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(a, a + n)), *(pa.array(own[k].astype(t)) for k, t in (("x", "f8"), ("y", "f8"), ("z", "f8"), ("intensity", "i4"), ("classification", "i4")))], names)


def las_points(content: bytes) -> dict[str, np.ndarray]:
    """Coordinates, intensity and class of an uncompressed LAS file's points."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, = struct.unpack_from("<I", content, 96)
    fmt, size, count = struct.unpack_from("<BHI", content, 104)
    if fmt & 0x80 or fmt & 0x40:
        raise ValueError("compressed LAS files can't be read")
    if content[25] >= 4 and count == 0:
        count, = struct.unpack_from("<Q", content, 247)
    scale, shift = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    where = 16 if fmt >= 6 else 15
    kind = np.dtype({"names": ["x", "y", "z", "intensity", "classification"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, where], "itemsize": size})
    rows = np.frombuffer(content, kind, count, offset)
    out = {a: rows[a] * scale[i] + shift[i] for i, a in enumerate("xyz")}
    return out | {"intensity": rows["intensity"], "classification": rows["classification"] & (255 if fmt >= 6 else 31)}


def read_las(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, point_id, x, y, z, intensity, classification)`` of LAS files; a file is one task's work."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_las_batches, "path string, point_id long, x double, y double, z double, intensity int, classification int")
