"""Exact top-k search by inner product (operator 6).

Vectors become integers, floor(64 x). Candidates are dealt into groups of bounded size along
a coarse KD-tree whose cuts come from a bounded sample (they only shape the groups); a leaf
with many rows is salted into several groups. In a task a group is cut into shards, each a
KD-tree: median splits on the widest axis, tight bounding boxes. A tree is walked best first
by the bound of a box to a set of alike queries, and a box is left out for a query whose
k-th score it can't reach.

The k-th score is propagated twice: from shard to shard in a task, and from group to group:
every query first searches the one group it would lie in, and only then, with that k-th
score, goes to the groups whose boxes can still reach it. Queries of a group come in blocks
of bounded size. The k best of a query's groups are merged by a window over the query.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written

K, SCALE, EVERY = 20, 64, 20
GROUP_ROWS, BLOCK_ROWS, SHARD_ROWS, LEAF_ROWS = 32_768, 8_192, 8_192, 256
_LEAST_GROUP = 1_024
CUT_SAMPLE = 20_000  # rows that the cuts between groups are taken from
_QUERY_SET = 64  # queries that walk a tree together
_TOP, _LOW = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class KDTree:
    """Nodes in build order: box ``low``/``high``, children or a slice of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.low)
            if parent >= 0:
                self.children[parent][side] = node
            own = points[self.order[a:b]]
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.rows.append((a, b))
            with np.errstate(over="ignore"):
                spread = self.high[-1] - self.low[-1]
            if b - a <= leaf_rows or not spread.any():  # equal points need no split: their box is exact
                self.children.append(None)
                continue
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
            self.children.append([-1, -1])
            todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a point of each box can score with each query, rounding allowed for."""
        return _bounds(queries, self.low, self.high)


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    size = _size(queries, np.maximum(np.abs(low), np.abs(high)))
    if size >= 1e300:
        return np.full((len(queries), len(low)), np.inf)
    most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return most if size < 2.0**53 else np.maximum(most + size * 1e-12, float(_LOW))


def _size(queries: np.ndarray, points: np.ndarray) -> float:
    """No inner product is larger."""
    with np.errstate(over="ignore"):
        return float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1]


def _scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those past the range of a long are its nearest end."""
    size = _size(queries, points)
    if size < 2.0**53:
        return (queries @ points.T).astype(np.int64)
    if size < 2.0**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(points).T, _LOW, _TOP).astype(np.int64)


def search(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int, least: np.ndarray | None = None, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of the query, id, score)`` of the k best points of another row for each query, ties to the smaller id.

    Points and queries are whole numbers as doubles, ``ids`` and ``rows`` (of points and queries) longs. ``least``: scores
    under it can't be among the best of a query.
    """
    score = np.full((len(queries), k), _LOW)
    found = np.full((len(queries), k), _TOP)
    held = np.zeros((len(queries), k), bool)
    kth = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64)
    leaves = KDTree(queries, _QUERY_SET)  # alike queries walk together
    sets = [leaves.order[i : min(e, i + _QUERY_SET)] for (s, e), inner in zip(leaves.rows, leaves.children, strict=True) if inner is None for i in range(s, e, _QUERY_SET)]
    for a in range(0, len(points), shard_rows):
        shard = points[a : a + shard_rows]
        tree = KDTree(shard, leaf_rows)
        for own in sets:
            q = queries[own]
            bound = tree.bounds(q)
            best = bound.max(axis=0)
            heap = [(-best[0], 0)]
            while heap:
                _, node = heapq.heappop(heap)
                reach = bound[:, node] >= kth[own]
                if not reach.any():
                    continue
                if tree.children[node] is not None:
                    for child in tree.children[node]:
                        heapq.heappush(heap, (-best[child], child))
                    continue
                who = own[reach]
                for i in range(*tree.rows[node], leaf_rows):
                    at = tree.order[i : min(tree.rows[node][1], i + leaf_rows)]
                    new = _scores(q[reach], shard[at])
                    other = rows[a + at][None, :] != query_rows[who][:, None]
                    fresh = (other & (new >= kth[who][:, None])).any(axis=1)
                    if not fresh.any():
                        continue
                    some, new, other = who[fresh], new[fresh], other[fresh]
                    scores = np.concatenate([score[some], new], axis=1)
                    names = np.concatenate([found[some], np.broadcast_to(ids[a + at], new.shape)], axis=1)
                    real = np.concatenate([held[some], other], axis=1)
                    order = np.lexsort((names, ~scores, ~real), axis=1)[:, :k]  # the complement falls as a score rises
                    score[some], found[some], held[some] = (np.take_along_axis(x, order, axis=1) for x in (scores, names, real))
                    kth[some] = np.where(held[some].all(axis=1), np.maximum(kth[some], score[some].min(axis=1)), kth[some])
    place, _ = np.nonzero(held)
    return place, found[held], score[held]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v)``: floor(64 x) of every vector without a null or non-finite component, as doubles that hold whole numbers; rows without id go."""
    x = F.col(vector_col).cast("array<double>")
    limit = F.lit(sys.float_info.max)
    scaled = F.transform(x, lambda c: F.greatest(F.least(F.lit(float(SCALE)) * c, limit), -limit))
    # from 2 ** 53 on every double is a whole number
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    finite = lambda v: F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    own = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite(x))
    return own.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class Cuts:
    """A coarse KD-tree over a sample: the leaf of a vector names the region it is dealt to."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; leaves have axis -1 and their number in ``left``
        self.leaves = 0
        self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, self.leaves, 0))
        with np.errstate(over="ignore"):
            spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(1)
        if leaves > 1 and spread.any():
            axis = int(spread.argmax())
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] < cut
            if not left.any():
                left, cut = points[:, axis] <= cut, float(np.nextafter(cut, np.inf))
            low = self._grow(points[left], leaves // 2)
            self.nodes[at] = (axis, cut, low, self._grow(points[~left], leaves - leaves // 2))
        else:
            self.leaves += 1
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        axis, cut, left, right = (np.array(c) for c in zip(*self.nodes, strict=True))
        while (inner := axis[node] >= 0).any():
            at = np.flatnonzero(inner)
            below = points[at, axis[node[at]]] < cut[node[at]]
            node[at] = np.where(below, left[node[at]], right[node[at]])
        return left[node]


def _dealt_batches(batches: Iterator[pa.RecordBatch], cuts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        lengths = batch.column(3).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n in cuts.value:
                out[at] = cuts.value[n].of(_matrix(batch.column(2).take(pa.array(at))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "leaf"])


def _box_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of the groups of a task's rows ``(length, group, v)``."""
    boxes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        keys = np.stack([c.to_numpy() for c in batch.columns[:2]], axis=1)
        for key in np.unique(keys, axis=0):
            own = _matrix(batch.column(2).take(pa.array(np.flatnonzero((keys == key).all(axis=1)))))
            low, high = own.min(axis=0), own.max(axis=0)
            if (k := tuple(key)) in boxes:
                low, high = np.minimum(low, boxes[k][0]), np.maximum(high, boxes[k][1])
            boxes[k] = low, high
    kind = pa.list_(pa.float64())
    columns = [pa.array([k[0] for k in boxes], pa.int32()), pa.array([k[1] for k in boxes], pa.int64()), *(pa.array([list(b[i]) for b in boxes.values()], kind) for i in (0, 1))]
    yield pa.RecordBatch.from_arrays(columns, ["length", "group", "low", "high"])


def _group_boxes(dealt: DataFrame) -> DataFrame:
    """``(length, group, low, high)``: one row for each group."""
    parts = dealt.select("length", "group", "v").mapInArrow(_box_batches, "length int, group long, low array<double>, high array<double>")
    sides = parts.select("length", "group", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "side"))
    sides = sides.groupBy("length", "group", "axis").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("axis", c))), lambda x: x[c]).alias(c)
    return sides.groupBy("length", "group").agg(listed("low"), listed("high"))


def _reach_batches(batches: Iterator[pa.RecordBatch], boxes) -> Iterator[pa.RecordBatch]:
    """For each query ``(row, length, leaf_group, v, least)`` the other groups whose boxes reach its k-th score."""
    for batch in batches:
        rows, groups = [], []
        lengths, homes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        least = batch.column(4).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            names, low, high = boxes.value[n]
            for i in range(0, len(own), 1024):
                at = own[i : i + 1024]
                near = _bounds(_matrix(batch.column(3).take(pa.array(at))), low, high) >= least[at][:, None]
                near &= names[None, :] != homes[at][:, None]
                q, g = np.nonzero(near)
                rows.append(at[q])
                groups.append(names[g])
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(groups) if groups else at)], ["row", "group"])


def _task(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    names = ["query_row", "query_id", "vec_id", "score"]
    if not candidates.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names)
    ids, rows = (candidates[c].to_numpy() for c in ("given_id", "given_row"))
    query_ids, query_rows = (queries[c].to_numpy() for c in ("id", "row"))
    place, found, score = search(_matrix(candidates["given_v"]), ids, rows, _matrix(queries["v"]), query_rows, k, queries["least"].to_numpy())
    return pa.table([pa.array(x) for x in (query_rows[place], query_ids[place], found, score)], names)


def _searched(dealt: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The k best of each query in each of its groups; ``queries(row, id, v, length, group, least)``."""
    sizes = queries.groupBy("length", "group").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")).withColumnsRenamed({"length": "of_length", "group": "of_group"})
    on = (F.col("length") == F.col("of_length")) & (F.col("group") == F.col("of_group"))
    asked = queries.join(sizes, on).select("row", "id", "v", "length", "group", "least", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
    given = dealt.join(sizes, on).select("row", "id", "v", "length", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    given = given.select(*[F.col(c).alias(f"given_{c}") for c in given.columns])
    key = ("length", "group", "block")
    return given.groupBy(*[f"given_{c}" for c in key]).cogroup(asked.groupBy(*key)).applyInArrow(partial(_task, k=k), "query_row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _cuts(own: DataFrame, n: int, leaves: int) -> dict[int, Cuts]:
    """Cuts for each length of vectors, from a bounded sample in order of a hash."""
    sample = own.where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < int(min(1.0, CUT_SAMPLE / max(1, n)) * 1_000_003) + 1).select("length", "v").toArrow()
    lengths = sample["length"].to_numpy()
    out = {}
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        out[length] = Cuts(_matrix(sample["v"].take(pa.array(at))), max(1, round(leaves * len(at) / len(lengths))))
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best vectors for every row whose id is divisible by ``every``.

    Vectors compare only with those of their length. Every row counts: rows that share an id are
    candidates and queries of their own, and only the query's own row is none of its candidates.
    Fewer than k others: all of them. Scores past the range of a long are its nearest end.
    """
    context = vectors.sparkSession.sparkContext
    own = integer_vectors(vectors, id_col, vector_col).withColumn("length", F.size("v"))
    own = written(own.select(F.monotonically_increasing_id().alias("row"), "id", "v", "length"), "vectors")
    n = own.count()
    # at least some groups for each core; a group never holds more than group_rows
    leaves = max(1, -(-2 * n // group_rows), min(-(-n // _LEAST_GROUP), 4 * context.defaultParallelism))
    group_rows = min(group_rows, max(_LEAST_GROUP, -(-2 * n // leaves)))
    cuts = context.broadcast(_cuts(own, n, leaves))
    placed = written(own.mapInArrow(partial(_dealt_batches, cuts=cuts), "row long, id long, v array<double>, length int, leaf long"), "placed")
    salts = written(placed.groupBy("length", "leaf").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("salts")), "leaves").withColumnsRenamed({"length": "of_length", "leaf": "of_leaf"})
    group: Column = F.col("leaf") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), F.col("salts"))
    dealt = written(placed.join(salts, (F.col("length") == F.col("of_length")) & (F.col("leaf") == F.col("of_leaf"))).select("row", "id", "v", "length", group.alias("group")), "dealt")
    queries = dealt.where(F.col("id") % every == 0)
    seeds = written(_best(_searched(dealt, queries.withColumn("least", F.lit(_LOW)), k, block_rows), k), "seeds")
    kth = seeds.where(F.col("rank") == k).select(F.col("query_row").alias("of_row"), F.col("score").alias("least"))
    asked = written(queries.join(kth, F.col("row") == F.col("of_row"), "left").select("row", "id", "v", "length", "group", F.coalesce("least", F.lit(_LOW)).alias("least")), "queries")
    boxes: dict[int, list] = {}
    for r in _group_boxes(dealt).toLocalIterator():  # a row for each group of up to group_rows vectors
        boxes.setdefault(r.length, []).append((r.group, r.low, r.high))
    shared = context.broadcast({m: tuple(np.array(c) for c in zip(*b, strict=True)) for m, b in boxes.items()})
    reach = asked.select("row", "length", "group", "v", "least").mapInArrow(partial(_reach_batches, boxes=shared), "row long, group long").withColumnsRenamed({"row": "of_row", "group": "to_group"})
    onward = asked.join(reach, F.col("row") == F.col("of_row")).select("row", "id", "v", "length", F.col("to_group").alias("group"), "least")
    found = seeds.drop("rank").unionByName(_searched(dealt, onward, k, block_rows))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
