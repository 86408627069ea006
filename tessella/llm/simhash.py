"""SimHash near-duplicate groups (operator 5).

Fingerprints: majority vote over the bits of the XXH64 of every 3-word shingle.
Links: tiled exact comparison - tiles of fingerprints sorted by population count are
compared by exclusive-or and bit count; tile pairs whose population counts differ by
more than the radius are skipped. Tiles over the whole table are exact by themselves
(``blocks=False``), but their work grows with its square. So by default they are cut inside
pigeonhole buckets: two 64-bit words within ``radius`` bits agree in full on at least one
choice of ``blocks - radius`` out of ``blocks`` blocks, so comparing inside every bucket of
every choice is as exact, and work follows the bucket sizes. A bucket (or the whole table)
above ``bucket_rows`` is split by population count and a salt into cells, and every pair of
cells within the radius becomes a task of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.session import spare_name, written

SHINGLE, SEED, RADIUS = 3, 42, 3
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1_000_000  # shingle hashes held at once by a task


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each 3-word shingle of a UTF-8 text; A-Z lower-cased, words cut at ASCII white space.

    Fewer than three words: one shingle of them all; none: no shingle.
    """
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)] * bool(words)
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of ``counts`` hashes; an empty group gives 0.

    Bit k of byte lanes is summed eight lanes at a time in runs of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.cumsum(n) - n
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    own = np.repeat(np.arange(len(n)), runs)
    cuts = starts[own] + 255 * (np.arange(runs.sum()) - first[own])
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for j in range(8):
            out[full] |= (2 * ones[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows, parts):
        counts = np.array([len(p) for p in parts], np.int64)
        prints = majority(np.concatenate(parts) if parts else np.empty(0, np.uint64), counts)
        return pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(prints.view(np.int64))], [*rows.schema.names[1:], "fp"])

    for batch in batches:
        start, parts, held = 0, [], 0
        for text in batch.column(0).cast(pa.binary()):
            parts.append(shingle_hashes(text.as_py() or b""))
            held += len(parts[-1])
            if held > _CHUNK:
                yield flush(batch.slice(start, len(parts)), parts)
                start, parts, held = start + len(parts), [], 0
        yield flush(batch.slice(start), parts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """``(doc_id, *more, fp)``: a 64-bit SimHash as signed long; a null or wordless text has 0. ``more``: columns of longs."""
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in more.items()])
    return own.mapInArrow(_fingerprint_batches, ", ".join(f"{n} long" for n in ("doc_id", *more, "fp")))


def _block_choices(n: int, radius: int, bucket_rows: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks as (first bit, width), and the choices of blocks that key a bucket: the fewest blocks
    whose buckets, evenly filled, hold at most ``bucket_rows`` of n fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 3):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        cut = [(a, b - a) for a, b in itertools.pairwise(edges)]
        choices = list(itertools.combinations(range(blocks), blocks - radius))
        if n / 2.0 ** min(sum(cut[i][1] for i in c) for c in choices) <= bucket_rows:
            break
    return cut, choices


def _local_links(prints: np.ndarray, nodes: np.ndarray, radius: int, tile: int, sides: np.ndarray | None) -> tuple[list, list]:
    """Links among the rows of one bucket (between side 0 and 1, if given), as few as keep rows joined.

    Rows are sorted by population count; tile pairs further apart than the radius are skipped.
    Within a tile pair each row is linked to the least node of its local component.
    """
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    prints, nodes = prints[order], nodes[order]
    sides = None if sides is None else sides[order]
    ones = np.bitwise_count(prints).astype(np.int64)
    starts = range(0, len(prints), tile)
    left, right = [], []
    for i in starts:
        for j in starts[i // tile :]:
            a, b = slice(i, i + tile), slice(j, j + tile)
            if ones[b][0] - ones[a][-1] > radius:
                break
            near = np.bitwise_count(prints[a, None] ^ prints[None, b]) <= radius
            if sides is not None:
                near &= sides[a, None] != sides[None, b]
            if not near.any():
                continue
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near = near[np.ix_(rows, cols)]
            x, y = nodes[a][rows], nodes[b][cols]
            top = np.iinfo(np.int64).max
            lx, ly = x.copy(), y.copy()
            while True:  # least label over each local component
                new_y = np.minimum(ly, np.where(near, lx[:, None], top).min(axis=0))
                new_x = np.minimum(lx, np.where(near, new_y[None, :], top).min(axis=1))
                if (new_x == lx).all() and (new_y == ly).all():
                    break
                lx, ly = new_x, new_y
            ends, roots = np.concatenate([x, y]), np.concatenate([lx, ly])
            left.append(ends[ends != roots])
            right.append(roots[ends != roots])
    return left, right


def _link_sorted(batches: Iterator[pa.RecordBatch], radius: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, cell, side, ones, fp, node)`` sorted by bucket, cell and population count; side -1: an undivided bucket.

    Buckets of up to 8 rows are compared all at once, larger ones tile by tile; pairs whose population counts differ by
    more than the radius are skipped in both.
    """

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, cell, side, ones, prints, nodes = rows
        prints = prints.view(np.uint64)
        fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[starts, len(bucket)])
        left, right = [], []
        small = np.repeat(sizes <= 8, sizes)
        group = np.cumsum(fresh)
        for d in range(1, 8):  # small buckets, all at once: rows d apart
            if d >= len(group):
                break
            near = (group[d:] == group[:-d]) & small[d:] & (ones[d:] - ones[:-d] <= radius) & ((side[d:] < 0) | (side[d:] != side[:-d]))
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
            left.append(nodes[at])
            right.append(nodes[at + d])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            x, y = _local_links(prints[s : s + n], nodes[s : s + n], radius, tile, side[s : s + n] if side[s] >= 0 else None)
            left += x
            right += y
        ends = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        # the last bucket may go on in the next batch
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        last = len(same) - np.argmin(same[::-1]) if not same.all() else 0
        held = [x[last:] for x in rows]
        if last:
            yield links([x[:last] for x in rows])
    if held is not None:
        yield links(held)


def links(reps: DataFrame, radius: int = RADIUS, bucket_rows: int = 16_384, tile: int = 1024, blocks: bool = True) -> DataFrame:
    """``reps(fp, node)`` with distinct fingerprints -> links ``(a, b)`` that join every pair within the radius.

    Not every such pair is listed: a dense bucket gives each row one link per tile pair,
    enough to keep its local component joined. ``blocks``: tiles inside pigeonhole buckets, else over the whole table.
    """
    spark = reps.sparkSession
    cut, choices = _block_choices(reps.count(), radius, bucket_rows)
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1 if w < 63 else -1)) for a, w in cut]
    keys = F.array(*[F.xxhash64(F.lit(k), *[parts[i] for i in c]) for k, c in enumerate(choices)]) if blocks else F.array(F.lit(0).cast("long"))
    rows = reps.select(F.explode(keys).alias("bucket"), "fp", "node")
    large = written(
        rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("salts")),
        "large_buckets",
    )
    rows = rows.join(large, "bucket", "left")
    whole = rows.where("salts is null").select("bucket", F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side"), "fp", "node")
    # cells: population count and salt; a row meets the cells up to ``radius`` above and below its own
    other = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("step")
    split = rows.where("salts is not null").withColumn("ones", F.bit_count("fp")).withColumn("salt", F.pmod(F.xxhash64("fp"), "salts"))
    split = split.select("*", other).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other_salt"))
    own = F.col("ones") * F.col("salts") + F.col("salt")
    far = (F.col("ones") + F.col("step")) * F.col("salts") + F.col("other_salt")
    low, high = F.least(own, far), F.greatest(own, far)
    split = split.select(
        "bucket",
        (1 + low + 4096 * F.col("salts") * high).cast("long").alias("cell"),
        F.when(own == far, -1).when(own < far, 0).otherwise(1).alias("side"),
        "fp",
        "node",
    )
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        whole.unionByName(split)
        .select("bucket", "cell", "side", F.bit_count("fp").alias("ones"), "fp", "node")
        .repartition(tasks, "bucket", "cell")
        .sortWithinPartitions("bucket", "cell", "ones")
        .mapInArrow(partial(_link_sorted, radius=radius, tile=tile), "a long, b long")
    )


def _linked(reps: DataFrame, radius: int) -> DataFrame:
    """``(node, component)`` of the fingerprints that lie near another: nodes are the fingerprints themselves."""
    return connected_components(links(reps.select("fp", F.col("fp").alias("node")), radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Exact copies share a fingerprint and collapse to one representative
    before any comparison. component_id is the least doc_id reachable over fingerprints
    that differ in ``radius`` bits or fewer. Null or wordless texts have fingerprint zero
    and link like any other; repeated rows each come back; a null id takes part with its
    text but never names a component unless its whole group lacks ids (then null).
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("own_least")), "representatives")
    groups = _linked(reps, radius)
    grouped = reps.join(groups, F.col("fp") == F.col("node"))
    least = written(grouped.groupBy("component").agg(F.min("own_least").alias("least")).withColumnRenamed("component", "of_component"), "least")
    named = groups.join(least, F.col("component") == F.col("of_component")).select("node", "least")
    named = reps.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("rep_fp"), F.coalesce("least", "own_least").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("rep_fp")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component of near copies the row of least id and one row without id.

    Rows are told apart by a written key, not by id. Equal ids are ordered by fingerprint and then by a
    hash of the whole row; rows that are equal in all of this are copies, and any one stays.
    """
    key = spare_name(docs, "row_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = written(fingerprints(keyed, id_col, text_col, row=F.col(key), tie=tie), "fingerprints")
    row = F.struct("doc_id", "fp", "tie", "row")
    best = {"named": F.col("doc_id").isNotNull(), "unnamed": F.col("doc_id").isNull()}
    reps = written(prints.groupBy("fp").agg(*[F.min(F.when(c, row)).alias(n) for n, c in best.items()]), "representatives")
    roots = reps.join(_linked(reps, radius), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    kept = roots.groupBy("root").agg(*[F.min(n)["row"].alias(n) for n in best]).select(F.explode(F.array(*best)).alias("kept_row"))
    kept = written(kept.where("kept_row is not null"), "kept")
    extra_row = spare_name(keyed, "extra_row")
    # a table of its own, so that its true size decides whether texts must be shuffled
    extra = written(prints.join(kept, F.col("row") == F.col("kept_row"), "left_anti").select(F.col("row").alias(extra_row)), "extra")
    return keyed.join(extra, F.col(key) == F.col(extra_row), "left_anti").drop(key)
