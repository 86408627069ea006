"""Baseline TIFF with GeoTIFF tags: strips or tiles, uncompressed or deflate, differencing of integers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes and struct codes of TIFF field types, sample formats, tag numbers.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _MATRIX, _KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a (classic) TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    out = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        where = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", raw, where)
        if kind not in _TYPES:
            continue
        code = f"{order}{n}s" if kind == 2 else order + _TYPES[kind] * n
        start = where + 8 if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", raw, where + 8)[0]
        out[tag] = struct.unpack_from(code, raw, start)
    return order, out


def read_tiff(raw: bytes) -> tuple[np.ndarray, tuple[float, ...] | None, int | None]:
    """Pixels (bands, height, width), affine coefficients a-f and the EPSG code, where given."""
    order, t = _tags(raw)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, bands = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    kind = np.dtype(f"{order}{_KINDS[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
    compression, predictor, planar = one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2
    if compression not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {compression} with predictor {predictor} can't be read")
    tiled = _TILE_W in t
    bw, bh = (t[_TILE_W][0], t[_TILE_H][0]) if tiled else (width, min(height, one(_ROWS, height)))
    depth = 1 if planar else bands
    out = np.zeros((bands, height, width), kind.newbyteorder("="))
    across, down = -(-width // bw), -(-height // bh)
    for k, (start, size) in enumerate(zip(t[_TILE_OFFSETS if tiled else _OFFSETS], t[_TILE_COUNTS if tiled else _COUNTS], strict=True)):
        plane, place = divmod(k, across * down) if planar else (0, k)
        i, j = divmod(place, across)
        rows = bh if tiled else min(bh, height - i * bh)
        data = raw[start : start + size] if compression == 1 else zlib.decompress(raw[start : start + size])
        block = np.frombuffer(data, kind, rows * bw * depth).reshape(rows, bw, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        h, w = min(rows, height - i * bh), min(bw, width - j * bw)
        out[plane : plane + depth, i * bh : i * bh + h, j * bw : j * bw + w] = block[:h, :w].transpose(2, 0, 1)
    transform = None
    if _MATRIX in t:
        m = t[_MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif _SCALE in t and _TIE in t:
        (sx, sy, _), (px, py, _, x, y, _) = t[_SCALE][:3], t[_TIE][:6]
        transform = (sx, 0.0, x - px * sx, 0.0, -sy, y + py * sy)
    keys = t.get(_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    return out, transform, codes.get(3072, codes.get(2048))


def tiff_bytes(data: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, compress: bool = False) -> bytes:
    """A TIFF of (bands, height, width): one strip of interleaved pixels, deflated with differencing of integers if asked for."""
    bands, height, width = data.shape
    kind = data.dtype.newbyteorder("<")
    pixels = np.ascontiguousarray(data.transpose(1, 2, 0))
    predictor = 2 if compress and data.dtype.kind in "iu" else 1
    if predictor == 2:
        pixels = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1)
    body = pixels.astype(kind).tobytes()
    body = zlib.compress(body) if compress else body
    tags: list[tuple[int, int, tuple]] = [
        (_WIDTH, 4, (width,)), (_HEIGHT, 4, (height,)), (_BITS, 3, (8 * kind.itemsize,) * bands), (_COMPRESSION, 3, (8 if compress else 1,)), (262, 3, (1,)),
        (_OFFSETS, 4, (8,)), (_SAMPLES, 3, (bands,)), (_ROWS, 4, (height,)), (_COUNTS, 4, (len(body),)), (_PLANAR, 3, (1,)), (_PREDICTOR, 3, (predictor,)), (_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands),
    ]
    if transform is not None:
        a, b, c, d, e, f = transform
        tags.append((_MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if epsg is not None:
        model = (1024, 0, 1, 2 if epsg == 4326 else 1), (2048 if epsg == 4326 else 3072, 0, 1, epsg)
        tags.append((_KEYS, 3, (1, 1, 0, 2, *model[0], *model[1])))
    head = 8 + len(body) + len(body) % 2
    entries, extra, at = b"", b"", head + 2 + 12 * len(tags) + 4
    for tag, code, values in tags:
        packed = struct.pack("<" + _TYPES[code] * len(values), *values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, code, len(values), at + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, code, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", head) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def resampled(data: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned, edges held."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(data.shape[1], height)
    x0, x1, fx = axis(data.shape[2], width)
    rows = data[:, y0] * (1 - fy)[:, None] + data[:, y1] * fy[:, None]
    out = rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx
    return np.rint(out).astype(data.dtype) if data.dtype.kind in "iu" else out.astype(data.dtype)


def _batches(batches: Iterator[pa.RecordBatch], block: int, scale_factor: float | None, ground_resolution: float | None) -> Iterator[pa.RecordBatch]:
    names = ["path", "width", "height", "epsg", "transform", "band", "block_row", "block_col", "pixels"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, transform, epsg = read_tiff(content)
            by = scale_factor
            if ground_resolution is not None:
                if transform is None or epsg is None or epsg == 4326:
                    raise ValueError(f"{path}: a ground resolution needs projected coordinates")
                by = abs(transform[0]) / ground_resolution
            if by is not None:
                data = resampled(data, max(1, int(data.shape[1] * by)), max(1, int(data.shape[2] * by)))
                transform = transform and tuple(v / by if k not in (2, 5) else v for k, v in enumerate(transform))
            _, height, width = data.shape
            for i in range(0, height, block):
                rows = []
                for b, image in enumerate(data):
                    for j in range(0, width, block):
                        whole = np.zeros((block, block))
                        part = image[i : i + block, j : j + block]
                        whole[: part.shape[0], : part.shape[1]] = part
                        rows.append((path, width, height, epsg, transform and list(transform), b, i // block, j // block, whole.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_tiff_blocks(spark: SparkSession, paths: str | list[str], block: int = 256, scale_factor: float | None = None, ground_resolution: float | None = None) -> DataFrame:
    """Square pixel blocks of TIFF rasters with their size, EPSG code and transform, resampled if asked for.

    ``scale_factor`` and ``ground_resolution`` exclude each other. A file is one task's work.
    """
    if scale_factor is not None and ground_resolution is not None:
        raise ValueError("give a scale factor or a ground resolution, not both")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "path string, width int, height int, epsg int, transform array<double>, band int, block_row long, block_col long, pixels array<double>"
    return files.mapInArrow(partial(_batches, block=block, scale_factor=scale_factor, ground_resolution=ground_resolution), schema)


def _encode(batches: Iterator[pa.RecordBatch], compress: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bands, height, width, transform, epsg in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            data = np.array(bands, np.float64).reshape(len(bands), height, width)
            out.append(tiff_bytes(data.astype(np.uint8), transform and tuple(transform), epsg, compress))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["file_name", "content"])


def encoded_tiles(tiles: DataFrame, compress: bool = True) -> DataFrame:
    """``(file_name, content)``: byte tiles ``(file_name, bands, height, width, transform, epsg)`` as TIFF files in rows.

    ``bands`` holds one pixel array for each band, ``transform`` six coefficients or null.
    """
    own = tiles.select("file_name", F.col("bands").cast("array<array<double>>"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("transform").cast("array<double>"), F.col("epsg").cast("int"))
    return own.mapInArrow(partial(_encode, compress=compress), "file_name string, content binary")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file can be found by Spark's own readers, wherever it is kept."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False
