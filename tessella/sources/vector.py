"""Vector labels: GeoJSON, Pascal-VOC XML, CSV boxes and GeoPackage, in and out.

Shapes are arrays of parts, parts arrays of rings, rings arrays of ``struct<x,y>``.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.box import box
from tessella.session import written

CHUNK_BYTES = 8 << 20  # of a document's text that a task writes at once
RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<array<{RING}>>"
_GEOJSON = "type string, features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def read_geojson(spark: SparkSession, paths: str | list[str], required: list[str] | None = None) -> DataFrame:
    """``(path, feature_id, kind, shape, attrs)``: a row for each polygonal feature; others have a null shape.

    Z is dropped. ``required`` properties that a feature lacks are an error.
    """
    docs = spark.read.schema(_GEOJSON).json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "features")
    rows = docs.select("path", F.posexplode("features").alias("feature_id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = lambda t: F.from_json(t, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    nested = F.when(kind == "Polygon", F.array(rings(text))).when(kind == "MultiPolygon", many)
    shape = F.transform(nested, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    out = rows.select("path", F.col("feature_id").cast("long").alias("feature_id"), kind.alias("kind"), shape.alias("shape"), F.col("f.properties").alias("attrs"))
    for name in required or []:
        lacking = ~F.map_contains_key(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.lit(name))
        out = out.where(F.when(lacking, F.raise_error(F.lit(f"a feature has no property {name}")).cast("boolean")).otherwise(True))
    return out


def geojson_lines(df: DataFrame, shape: str = "shape", attrs: list[str] | None = None) -> DataFrame:
    """``value``: one GeoJSON feature for each row."""
    coordinates = F.transform(F.col(shape), lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    properties = F.struct(*[F.col(c) for c in attrs or [c for c in df.columns if c != shape]])
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, shape: str = "shape", order: list[str] | None = None) -> None:
    """One FeatureCollection in one file, written in parallel (see ``text_document``)."""
    keys = order or [c for c in df.columns if c != shape][:1]
    body = geojson_lines(df.orderBy(*keys), shape)
    text_document(body, path, '{"type":"FeatureCollection","features":[', "]}")


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's lines as chunks of about CHUNK_BYTES, commas between them; whether a chunk begins or ends with a closing line."""
    names = ["part", "seq", "body", "opens", "closes"]
    lines: list[str] = []
    size = seq = 0

    def chunk():
        nonlocal seq, lines, size
        body = "".join(("," if i and not v.startswith("]") and not lines[i - 1].startswith("]") else "") + v for i, v in enumerate(lines)).encode()
        row = [[TaskContext.get().partitionId()], [seq], [body], [lines[0].startswith("]")], [lines[-1].startswith("]")]]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        seq, lines, size = seq + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for v in batch.column(0).to_pylist():
            lines.append(v)
            size += len(v)
            if size >= CHUNK_BYTES:
                yield chunk()
    if lines:
        yield chunk()


def _place_batches(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    """Write each chunk at its place of the file; a task that runs again writes the same."""
    for batch in batches:
        with open(target, "r+b", buffering=0) as out:
            for comma, start, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview((b"," if comma else b"") + body)
                while view:
                    n = os.pwrite(out.fileno(), view, start)
                    view, start = view[n:], start + n
            os.fsync(out.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])


def text_document(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """A JSON document in one file: ``lines(value)`` in order between head and tail, commas between them.

    A line that begins with ``]`` closes a list and has no comma around it; so must the tail. Two phases: tasks
    write their lines as chunks of bytes; the driver adds up their lengths (a row for each CHUNK_BYTES) to places in the
    file; tasks write the chunks there, into a file of another name, which is renamed at last. No task sees more than
    its lines. That needs a file system with writes at a place, which driver and executors share (``file:``); on others the
    document is a folder with one part, streamed by one task.
    """
    spark = lines.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    if where.toUri().getScheme() != "file":
        _streamed_document(lines, path, head, tail)
        return
    target = where.toUri().getPath()
    chunks = written(lines.mapInArrow(_chunk_batches, "part long, seq long, body binary, opens boolean, closes boolean"), "chunks")
    sizes = chunks.select("part", "seq", "opens", "closes", F.octet_length("body").alias("n")).orderBy("part", "seq").collect()
    start, after_open, places = len(head.encode()), True, []
    for r in sizes:
        comma = not after_open and not r.opens
        places.append((r.part, r.seq, comma, start))
        start, after_open = start + r.n + comma, r.closes
    os.makedirs(os.path.dirname(target), exist_ok=True)
    fresh = f"{target}.{uuid.uuid4().hex}.tmp"
    with open(fresh, "wb") as out:
        out.write(head.encode())
        out.seek(start)
        out.write(tail.encode())
    if places:
        at = spark.createDataFrame(places, "p long, s long, comma boolean, start long")
        put = chunks.join(at, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("comma", "start", "body")
        done = put.mapInArrow(partial(_place_batches, target=fresh), "n long").agg(F.sum("n")).first()[0]
        if done != len(places):
            raise RuntimeError(f"{done} of {len(places)} chunks of {path} were written")
    os.replace(fresh, target)


def _streamed_document(lines: DataFrame, path: str, head: str, tail: str) -> None:
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = head
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                closing = v.startswith("]")
                out.append(("" if closing and sep == "," else sep) + v)
                sep = "" if closing else ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    last = lines.sparkSession.createDataFrame([(tail,)], "value string")  # so that an empty document is written too
    lines.coalesce(1).union(last.coalesce(1)).coalesce(1).mapInArrow(joined, "value string").write.mode("overwrite").text(path)


def read_voc(spark: SparkSession, paths: str | list[str], attribute: str | None = "name") -> DataFrame:
    """``(path, shape_box, category)``: a row for each ``object`` of Pascal-VOC files; bounds as whole numbers."""
    bounds = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"bndbox {bounds}" + (f", `{attribute}` string" if attribute else "")
    rows = spark.read.format("xml").option("rowTag", "object").schema(schema).load(paths).select("*", F.col("_metadata.file_path").alias("path"))
    whole = [F.floor(F.col(f"bndbox.{c}")).cast("int") for c in ("xmin", "ymin", "xmax", "ymax")]
    category = F.lit(None).cast("string")
    if attribute:
        found = F.col(attribute)
        category = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"an object has no {attribute}")))
    return rows.select("path", box(*whole).alias("shape_box"), category.alias("category"))


def read_boxes_csv(spark: SparkSession, path: str, image: str, by_name: bool = True, category: str | None = None) -> DataFrame:
    """``(shape_box, category)`` of one image: columns ``img_name, Xmin, ...`` or ``img_path, xmin, ...``."""
    rows = spark.read.csv(path, header=True)
    key, sides = ("img_name", ("Xmin", "Ymin", "Xmax", "Ymax")) if by_name else ("img_path", ("xmin", "ymin", "xmax", "ymax"))
    value = F.col(category) if category else F.lit(None).cast("string")
    return rows.where(F.col(key) == image).select(box(*[F.col(s).cast("double") for s in sides]).alias("shape_box"), value.alias("category"))


# ---- GeoPackage: an SQLite file, read and written from its bytes


def wkb_parts(raw: bytes) -> list | None:
    """Parts of a (multi)polygon in WKB, Z and M dropped; None for other kinds."""
    out: list = []

    def geometry(at: int) -> int:
        order = "<" if raw[at] else ">"
        (kind,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5 + 4 * bool(kind & 0x20000000)
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
        base = kind & 0xFFFF
        base %= 1000
        if base not in (3, 6):
            raise ValueError(base)
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        if base == 6:
            for _ in range(n):
                at = geometry(at)
            return at
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            flat = struct.unpack_from(f"{order}{m * dims}d", raw, at + 4)
            rings.append([{"x": flat[i], "y": flat[i + 1]} for i in range(0, m * dims, dims)])
            at += 4 + 8 * m * dims
        out.append(rings)
        return at

    try:
        geometry(0)
    except (ValueError, IndexError):
        return None
    return out


def parts_wkb(parts: list) -> bytes:
    """A multipolygon in little-endian WKB."""
    out = struct.pack("<BII", 1, 6, len(parts))
    for rings in parts:
        out += struct.pack("<BII", 1, 3, len(rings))
        for ring in rings:
            out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in ring)
    return out


def _read_gpkg_batches(batches: Iterator[pa.RecordBatch], layer: str | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            con = sqlite3.connect(":memory:")
            con.deserialize(content)
            con.row_factory = sqlite3.Row
            tables = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
            own = next((t for t in tables if layer in (None, t["table_name"])), None)
            if own is None:
                raise ValueError(f"{path} has no layer {layer or 'with geometry'}")
            rows: tuple[list, ...] = ([], [], [], [])
            for i, r in enumerate(con.execute('SELECT * FROM "{}"'.format(own["table_name"].replace('"', '""')))):
                blob = r[own["column_name"]]
                size = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                rows[0].append(i)
                rows[1].append(wkb_parts(blob[8 + size :]) if blob else None)
                rows[2].append({k: str(r[k]) for k in r.keys() if k != own["column_name"] and r[k] is not None}.items())  # noqa: SIM118
                rows[3].append(own["srs_id"] if own["srs_id"] > 0 else None)
            con.close()
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(rows[0], pa.int64()), pa.array(rows[1], kind), pa.array([list(x) for x in rows[2]], pa.map_(pa.string(), pa.string())), pa.array(rows[3], pa.int32())], ["path", "feature_id", "shape", "attrs", "srid"])


_ARROW_SHAPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def read_gpkg(spark: SparkSession, paths: str | list[str], layer: str | None = None) -> DataFrame:
    """``(path, feature_id, shape, attrs, srid)`` of the named layer, or the first with geometry, of each file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(partial(_read_gpkg_batches, layer=layer, kind=_ARROW_SHAPE), f"path string, feature_id long, shape {SHAPE}, attrs map<string,string>, srid int")


def gpkg_bytes(rows: list[dict], attrs: list[str], srid: int | None, layer: str = "features") -> bytes:
    """A GeoPackage of rows with a ``shape``; other columns as text."""
    srs = srid or -1
    with tempfile.TemporaryDirectory() as tmp:
        con = sqlite3.connect(Path(tmp) / "out.gpkg")
        con.executescript(
            f"""PRAGMA application_id = 1196444487;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('own', {srs}, 'EPSG', {srs}, 'undefined');
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, srs_id INTEGER);
            INSERT INTO gpkg_contents VALUES ('{layer}', 'features', '{layer}', {srs});
            CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);
            INSERT INTO gpkg_geometry_columns VALUES ('{layer}', 'geom', 'MULTIPOLYGON', {srs}, 0, 0);"""
        )
        names = ", ".join(f'"{a}" TEXT' for a in attrs)
        con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{", " + names if names else ""})')
        head = b"GP\x00\x01" + struct.pack("<i", srs)
        con.executemany(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (2 + len(attrs)))})', [(i + 1, head + parts_wkb(r["shape"] or []), *(None if r[a] is None else str(r[a]) for a in attrs)) for i, r in enumerate(rows)])
        con.commit()
        out = con.serialize()
        con.close()
    return out
