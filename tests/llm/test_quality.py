import zlib

import numpy as np

from tessella.llm import quality
from tessella.session import table

SF = "/root/testdata/sf0.01"


def test_forest_walk_matches_a_plain_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    f = quality.fit_forest(x, y, trees=30, depth=3)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.97
    for row in x[:40]:
        total = f.start
        for t in range(30):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(row[f.feature[t, k]] > f.cut[t, k])
            total += f.leaf[t, k - 7]
        assert abs(total - f.raw(row[None])[0]) < 1e-9


def test_statistics_of_odd_texts():
    assert quality.statistics(b"") == quality.statistics(b" \n\t") == [0.0] * len(quality.FEATURES)
    for t in (b"a", b"!", b"\xc3\xa9" * 10, b"word " * 50_000, b"x" * 200_000, b"\n\n a b \n\n"):
        row = quality.statistics(t)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()
    row = dict(zip(quality.FEATURES, quality.statistics(b"aa aa BB!\nCC | dd"), strict=True))
    assert row["repeats"] == 1 / 6 and row["bars"] == 1 / 6 and row["shouted"] == 2 / 6 and row["line_words"] == 3


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame([(70_001, None, None, None, None), (70_002, "", "en", "s", 0)], docs.schema)
    got = {r.doc_id: r for r in quality.scored(docs.unionByName(odd), labels).collect()}
    assert len(got) == docs.count() + 2
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    lies = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in quality.scored(docs, x).collect()} for x in (labels, lies))
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs, labels = table(spark, SF, "documents").limit(5), table(spark, SF, "labels")
    assert {r.score for r in quality.scored(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.scored(docs.where("doc_id < 0"), labels.where("doc_id < 0")).count() == 0


def test_first_tree_matches_a_plain_search():
    """Every cut of every node by plain sums over its rows, without histograms."""
    r = np.random.default_rng(3)
    x, rate, ridge, least = r.integers(0, 20, (120, 3)).astype(float), 0.15, 1.0, 5
    y = (x[:, 0] + 2 * x[:, 2] + r.normal(size=120) * 4 > 30).astype(float)
    f = quality.fit_forest(x, y, trees=1, depth=2)
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)

    def gain(rows, j, cut):
        left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
        return part(left) + part(right) - part(rows) if min(len(left), len(right)) >= least else -1.0

    groups = {0: np.arange(120)}
    for k in range(3):
        rows = groups[k]
        j, cut = f.feature[0, k], f.cut[0, k]
        most = max(gain(rows, i, c) for i in range(3) for c in np.unique(x[:, i]))
        if np.isinf(cut):
            assert most <= 1e-9
        else:
            assert abs(gain(rows, j, cut) - most) < 1e-9
        groups[2 * k + 1], groups[2 * k + 2] = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
    for k in range(4):
        rows = groups[3 + k]
        assert abs(f.leaf[0, k] + rate * g[rows].sum() / (h[rows].sum() + ridge)) < 1e-9


def test_repeated_rows_and_clashing_columns(spark):
    docs, labels = table(spark, SF, "documents").where("doc_id < 60"), table(spark, SF, "labels")
    more = docs.unionByName(docs.where("doc_id < 5")).selectExpr("*", "0 as quality", "1 as score", "2 as held_out", "3 as label")
    got = quality.scored(more, labels).collect()
    assert len(got) == more.count()
    assert all(len({x.score for x in got if x.doc_id == i}) == 1 for i in range(5) if any(x.doc_id == i for x in got))
