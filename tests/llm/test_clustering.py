import hashlib
import math
import random

import pytest

from tessella.llm import clustering, oracles
from tests.compare import same

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10):
    """Plain k-means on Python's whole numbers."""
    kept = [(i, [clustering._whole(x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in named[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    top = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(total[c], top), min(sum(total.values()), top), sha[c]) for i, c, d in found), key=str)


def vectors(n=150, wide=False):
    r = random.Random(3)
    spots = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [s + r.gauss(0, 0.3) for s in r.choice(spots)]) for i in range(n)]
    rows += [rows[0], rows[0], (3, rows[4][1]), (None, rows[5][1]), (900, [0.5] * 64), (901, [0.5] * 64)]
    rows += [(902, None), (903, []), (904, [0.1] * 63), (905, [float("nan")] * 64), (906, [None] + [0.1] * 63), (907, [float("inf")] * 64), (None, None)]
    if wide:
        rows += [(950, [3e38] * 64), (951, [-5000.0] * 64), (952, [4095.9] * 64)]
    return rows


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def float32(rows):
    import numpy as np

    return [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("wide", [False, True])
def test_matches_brute_force(spark, wide, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 16)
    rows = vectors(wide=wide)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert plain(clustering.clustered(df)) == brute(float32(rows))


def test_matches_sql(spark):
    rows = [r for r in vectors() if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert same(clustering.clustered(df.selectExpr("*", "1 as cluster", "2 as block")), oracles.CLUSTERS, tables={"embeddings": df.toArrow()}) > 100


def test_few_equal_and_no_vectors(spark):
    few = [(5, [1.0] * 64), (6, [2.0] * 64), (7, [2.0] * 64)]
    assert plain(clustering.clustered(spark.createDataFrame(few, SCHEMA))) == brute(few)
    assert clustering.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustering.clustered(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)).count() == 0


def test_only_relevant_neighbours_are_compared(monkeypatch):
    import numpy as np

    balls = clustering.Balls([[0] * 4, [100] * 4, [10_000] * 4])
    seen = []
    real = clustering.Balls.distances
    monkeypatch.setattr(clustering.Balls, "distances", lambda self, rows, c: seen.append((c, len(rows))) or real(self, rows, c))
    rows = np.array([[1.0] * 4, [49.0] * 4, [50.0] * 4, [51.0] * 4])
    clusters, d = balls.assigned(rows, np.zeros(4, np.int32))
    assert clusters.tolist() == [0, 0, 0, 1] and d.tolist() == [4, 4 * 49**2, 4 * 2500, 4 * 49**2]
    assert seen == [(0, 4), (1, 2)]  # the core of two stays, the far centroid is never met
    # a tie goes to the smaller number, from either side
    assert balls.assigned(rows[2:3], np.ones(1, np.int32))[0].tolist() == [0]
