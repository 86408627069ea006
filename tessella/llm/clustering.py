"""Centroid clustering (operator 12): ball k-means on whole numbers, so the result is exact.

Vectors are packed into blocks, which are written once, in buckets. A round joins each block with
the clusters of its vectors (same buckets: no exchange), and a cluster's members in a block form a
ball around its centroid. Only centroids nearer than twice the ball's radius are neighbours. Members
nearer than half the way to the nearest centroid are the stable core and stay without another
distance; the rest lie in annuli between the half ways to the neighbours in order, and a member of
an annulus is compared with the neighbours that come before it, no others. Equality counts as
reach, so that ties go to the smaller number. Counts and sums of the clusters are tree-summed.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.trees import tree_sum
from tessella.session import written, written_buckets

CLUSTERS, ROUNDS, SIZE, SCALE, SALT = 8, 10, 64, 1024, "3:"
BLOCK_ROWS, BUCKET_BYTES, MOST_BUCKETS = 4096, 1 << 27, 100_000
#: Components below it in size give squared distances that doubles hold exactly.
_NARROW = 1 << 22
_TOP = (1 << 63) - 1


def _whole(x: float) -> int:
    """floor(SCALE * x), of any size."""
    return math.floor(SCALE * x) if abs(x) < 1 << 53 else SCALE * int(x)


def _pack_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Vectors of ``size`` finite components as blocks of whole numbers; those with large components in blocks of their own, as text."""
    done = 0
    names = ["block", "wide", "ids", "data"]

    def blocks(ids, rows, wide):
        nonlocal done
        for i in range(0, len(rows), BLOCK_ROWS):
            own = rows[i : i + BLOCK_ROWS]
            raw = ";".join(",".join(map(str, map(_whole, r))) for r in own.tolist()).encode() if wide else np.floor(own * SCALE).astype("<i4").tobytes()
            block = TaskContext.get().partitionId() << 33 | done
            done += 1
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.slice(i, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([wide]), lists, pa.array([raw], pa.binary())], names)

    for batch in batches:
        right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False)
        batch = batch.filter(right)
        rows = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, size)  # a null component is not a number
        finite = np.isfinite(rows).all(axis=1)
        narrow = finite & (np.abs(rows) < _NARROW // SCALE - 1).all(axis=1)
        for chosen, wide in ((narrow, False), (finite & ~narrow, True)):
            yield from blocks(batch.column(0).filter(pa.array(chosen)), rows[chosen], wide)


def _unpacked(raw: bytes, wide: bool, size: int) -> np.ndarray:
    if wide:
        return np.array([list(map(int, row.split(b","))) for row in raw.split(b";")], object)
    return np.frombuffer(raw, "<i4").reshape(-1, size).astype(np.float64)


@dataclass
class Balls:
    """Centroids of a round as whole numbers, and the squared distances between them."""

    centroids: list[list[int]]

    def __post_init__(self):
        self.wide = np.array(self.centroids, object)
        self.narrow = bool((abs(self.wide) < _NARROW).all())
        self.apart = np.array([[int(((a - b) ** 2).sum()) for b in self.wide] for a in self.wide], object)

    def distances(self, rows: np.ndarray, cluster: int) -> np.ndarray:
        """Exact squared distances of rows to a centroid: doubles that hold whole numbers, or Python's."""
        if rows.dtype == object or not self.narrow:
            rows = rows if rows.dtype == object else rows.astype(np.int64).astype(object)
            return ((rows - self.wide[cluster]) ** 2).sum(axis=1)
        off = rows - self.wide[cluster].astype(np.float64)
        return np.einsum("ij,ij->i", off, off)

    def assigned(self, rows: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance; ``before``: the clusters of the last round."""
        n, k = len(rows), len(self.centroids)
        own = np.zeros(n, np.int64) if before is None else before.astype(np.int64)
        clusters, least = own.copy(), np.zeros(n, object if rows.dtype == object or not self.narrow else np.float64)
        for c in np.unique(own).tolist():
            at = np.flatnonzero(own == c)
            near = self.distances(rows[at], c)
            least[at] = near
            radius = 4 * near.max()
            neighbours = sorted((self.apart[c][j], j) for j in range(k) if j != c and self.apart[c][j] <= radius)
            for apart, j in neighbours:
                # the annuli from this neighbour's half way outwards; what is nearer to the centroid is done
                some = at[4 * near >= apart]
                d = self.distances(rows[some], j)
                better = (d < least[some]) | ((d == least[some]) & (j < clusters[some]))
                clusters[some[better]], least[some[better]] = j, d[better]
        return clusters, least


def _sums(values: list[bytes]) -> bytes:
    """Pickled (counts, sums) of the clusters, added as Python's whole numbers."""
    parts = [pickle.loads(v) for v in values]
    return pickle.dumps(([sum(x) for x in zip(*(p[0] for p in parts), strict=True)], [[sum(x) for x in zip(*rows, strict=True)] for rows in zip(*(p[1] for p in parts), strict=True)]))


def _round_batches(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    """Clusters of each block's vectors; the task's counts and sums stand in its last row."""
    balls: Balls = shared.value
    k = len(balls.centroids)
    counts, sums, wide_sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros((k, size), object)
    last = None

    def row(block, clusters, value=None):
        columns = [pa.array([block], pa.int64()), pa.array([clusters.astype("<i4").tobytes()], pa.binary()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "clusters", "leaf", "value"])

    for batch in batches:
        for block, wide, data, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = _unpacked(data, wide, size)
            clusters, _ = balls.assigned(rows, None if before is None else np.frombuffer(before, "<i4"))
            counts += np.bincount(clusters, minlength=k)
            for c in np.unique(clusters).tolist():
                if wide:
                    wide_sums[c] += rows[clusters == c].sum(axis=0)
                else:
                    sums[c] += rows[clusters == c].sum(axis=0).astype(np.int64)
            if last:
                yield row(*last)
            last = (block, clusters)
    if last:
        yield row(*last, pickle.dumps((counts.tolist(), (sums.astype(object) + wide_sums).tolist())))


def _final_batches(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    balls: Balls = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            wide, ids, data, before = (batch.column(k)[i] for k in range(4))
            before = before.as_py()
            clusters, d = balls.assigned(_unpacked(data.as_py(), wide.as_py(), size), None if before is None else np.frombuffer(before, "<i4"))
            d = np.minimum(d, _TOP) if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(clusters, pa.int32()), pa.array(d.astype(np.int64))], ["vec_id", "cluster", "distance"])


def _first_centroids(own: DataFrame, clusters: int, size: int) -> list[list[int]]:
    sound = own.where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    hashed = sound.withColumn("h", F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")).cast("binary"), 256))
    return [[_whole(x) for x in r.v] for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector of ``size`` finite components.

    Other vectors take no part. Every row of a repeated id counts; rows without id count too, but start
    no centroid while others can. Fewer vectors than ``clusters``: as many centroids; none: no rows.
    Components of any size are exact; a distance or inertia past the range of a long is its end.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = own.schema["vec_id"].dataType.simpleString()
    centroids = _first_centroids(own, clusters, size)
    packed = written(own.mapInArrow(partial(_pack_batches, size=size), f"block long, wide boolean, ids array<{kind}>, data binary"), "vector_blocks")
    held = packed.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES)))
    blocks = written_buckets(packed.repartition(buckets, "block"), "vector_buckets", "block", buckets)
    state = None

    def joined(columns: list[str]) -> DataFrame:
        if state is None:
            return blocks.select(*columns, F.lit(None).cast("binary").alias("clusters"))
        known = state.select(F.col("block").alias("of_block"), "clusters")
        return blocks.join(known.hint("shuffle_hash"), F.col("block") == F.col("of_block")).select(*columns, "clusters")

    for _ in range(rounds if centroids else 0):
        shared = spark.sparkContext.broadcast(Balls(centroids))
        step = joined(["block", "wide", "data"]).mapInArrow(partial(_round_batches, shared=shared, size=size), "block long, clusters binary, leaf long, value binary")
        state = written_buckets(step, "cluster_buckets", "block", buckets)
        leaves = written(state.where("value is not null").select(F.lit(0).cast("long").alias("part"), "leaf", "value"), "cluster_sums")
        counts, sums = pickle.loads(_sums([bytes(r.value) for r in tree_sum(leaves, _sums).collect()]))
        centroids = [[s // n for s in row] if n else old for n, row, old in zip(counts, sums, centroids, strict=True)]
        shared.destroy()
    shared = spark.sparkContext.broadcast(Balls(centroids))
    out = joined(["wide", "ids", "data"]).mapInArrow(partial(_final_batches, shared=shared, size=size), f"vec_id {kind}, cluster int, distance long")
    out = written(out, "clustered")
    by_cluster = dict(out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    end = lambda x: F.lit(min(int(x), _TOP)).cast("long")
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([end(by_cluster.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        end(sum(by_cluster.values())).alias("inertia"),
        of_cluster([F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("string").alias("centroid_sha256"),
    )
