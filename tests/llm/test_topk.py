import math
from collections import Counter

import numpy as np

from tessella.llm import oracles, topk
from tessella.session import table
from tests.compare import same


def brute(rows, k, every):
    ints = []
    for i, v in rows:
        if i is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        ints.append((i, [math.floor(64 * c) for c in v]))
    out = Counter()
    for n, (q, x) in enumerate(ints):
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), i) for m, (i, y) in enumerate(ints) if m != n and len(y) == len(x))
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))
    return out


def test_tree_boxes_are_tight_and_bounds_hold():
    r = np.random.default_rng(0)
    p = r.integers(-30, 30, (700, 6))
    t = topk.KDTree(p, 16)
    q = r.integers(-30, 30, (5, 6))
    b = t.bounds(q)
    for n, (a, e) in enumerate(t.rows):
        own = p[t.order[a:e]]
        assert (own.min(0) == t.low[n]).all() and (own.max(0) == t.high[n]).all()
        assert ((q @ own.T).max(axis=1) <= b[:, n]).all()
    assert sorted(t.order) == list(range(700))


def test_search_matches_brute_force_with_ties():
    r = np.random.default_rng(1)
    p = np.concatenate([r.integers(-3, 4, (900, 5)), np.ones((400, 5), int)])
    ids = np.sort(r.choice(10**12, len(p), replace=False))
    q = p[::37]
    rows = np.arange(len(p))
    row, got, score = topk.search(p.astype(float), ids, rows, q.astype(float), rows[::37], 10, shard_rows=200, leaf_rows=32)
    for i in range(len(q)):
        want = sorted((-int(s), int(j)) for s, j in zip(p @ q[i], ids, strict=True) if j != ids[::37][i])[:10]
        assert sorted((-int(s), int(j)) for s, j in zip(score[row == i], got[row == i], strict=True)) == want


def test_frames_match_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(c)) for c in r.normal(size=8) / 3], "x") for i in range(0, 300)]
    rows += [(1000 + i, [0.25] * 8, "x") for i in range(60)]
    rows += [(2000, None, "x"), (2020, [float("nan")] * 8, "x"), (2040, [None] * 8, "x"), (None, [1.0] * 8, "x"), (2060, [], "x"), (2080, [0.5, 0.5], "x"), (2081, [0.5, -0.5], "x"), (20, [0.1] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    got = Counter(tuple(x) for x in topk.top_k(df, group_rows=90, block_rows=7).collect())
    assert got == brute(rows, 20, 20)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_clustered_vectors_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "_LEAST_GROUP", 32)
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 5)) * 3
    rows = [(int(i), [float(c) for c in centres[i % 9] + r.normal(size=5) / 4]) for i in range(700)]
    rows += [(i, [1.0] * 5) for i in range(800, 1100)] + [(i % 40, [2.0, 0.0, 0.0, 0.0, -1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(x) for x in topk.top_k(df, k=7, group_rows=64, block_rows=5).collect()) == brute(rows, 7, 20)


def test_large_values_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    rows = [(20, [1.0]), (21, [2.0]), (21, [3.0]), (20, [1.0])]
    rows += [(40 + i, [float(c) * 20_000 for c in r.normal(size=64)]) for i in range(25)]
    rows += [(100 + i, [float(c) * 10.0 ** (i % 9 * 20) for c in r.normal(size=2)]) for i in range(45)]
    rows += [(200 + i, [s * 1.7e308, 1.0, -1e9 + i]) for i in range(12) for s in (1, -1)]
    rows += [(i, [-1e-20, 0.0, -0.0, 1e-20]) for i in (300, 301)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(x) for x in topk.top_k(df, k=3).collect())
    want = brute([(i, [max(-1.7976931348623157e308 / 64, min(1.7976931348623157e308 / 64, c)) for c in v]) for i, v in rows], 3, 20)
    assert got == want and got[20, 1, 21, 12288] == 2


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(topk.top_k(table(spark, sf, "embeddings")), oracles.TOP_K, sf)
