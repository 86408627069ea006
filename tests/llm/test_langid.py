import zlib

import numpy as np
import pytest

from tessella.llm import langid
from tessella.session import table

SF = "/root/testdata/sf0.001"


def test_slots_by_hand():
    codes = langid._codes("Ab  É")
    assert codes[:5].tolist() == [ord(c) for c in " ab é"] and len(codes) == 5 + langid.ORDERS
    at = langid.slots(codes)
    again = langid.slots(np.concatenate([codes, langid._codes("xyz")]))
    assert (at[:, :5] == again[:, :5]).all() and at.max() < 1 << langid.BITS


def test_ftrl_separates_and_is_sparse():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(r.integers(3))
        at = np.array([y, 3 + int(r.integers(40))])
        rows.append((at, np.ones(2), y))
    w, b = langid.fit_ftrl(rows, 60, 3, l1=0.5)
    assert all(np.argmax(x @ w[at] + b) == y for at, x, y in rows)
    assert (w[50:] == 0).all() and (w[3:43] == 0).mean() > 0.3


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3))
    y = np.array([r.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.fit_temperature(logits * 3, y) - 3) < 0.6


@pytest.fixture(scope="module")
def result(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(9001, None, None), (9002, "en", ""), (9003, None, "123 !!"), (9004, None, "é" * 200_000)], docs.schema)
    rows = langid.identify(docs.unionByName(odd), per_language=60).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    return {r.doc_id: r for r in rows}


def test_held_out_accuracy(result):
    rows = [r for r in result.values() if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in result.items())
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(result):
    assert [result[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    assert result[9001].score == 0 and result[9004].lang_pred == "fr"


def test_many_labels_get_fewer_slots_and_all_are_learned(spark, monkeypatch):
    assert [langid.slot_bits(n) for n in (1, 4, 400, 401, 800, 801, 10**9)] == [16, 16, 16, 15, 15, 14, 8]
    monkeypatch.setattr(langid, "FULL_LANGUAGES", 4)
    words = [chr(0x4E00 + k) * 3 + chr(0x400 + k) * 4 for k in range(30)]
    rows = [(i, f"l{i % 30:02}", f"{words[i % 30]} {i} {words[i % 30]}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.identify(df).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 30:02}" for r in got) >= 0.95 * len(got)
    few = langid.fit(df, sample_rows=30)
    assert len(few.languages) == 30 and len(few.weights) == 1 << 13


def test_ftrl_step_is_that_of_a_plain_computation():
    """Two steps of two rows each against scalar arithmetic."""
    rows = [(np.array([0, 2]), np.array([1.0, 2.0]), 0), (np.array([1, 2]), np.array([3.0, 0.5]), 1), (np.array([0]), np.array([1.0]), 1), (np.array([1]), np.array([2.0]), 0)]
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-4
    z, n = [[0.0] * 2 for _ in range(4)], [[0.0] * 2 for _ in range(4)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - np.sign(z[i][c]) * l1) / ((beta + n[i][c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(1).permutation(4)
    for k in (0, 2):
        w = [[weight(i, c) for c in range(2)] for i in range(4)]
        g = [[0.0] * 2 for _ in range(4)]
        for i in order[k : k + 2]:
            at, x, y = rows[i]
            full = [*zip(at, x, strict=True), (3, 1.0)]
            e = np.exp([sum(v * w[j][c] for j, v in full) for c in range(2)])
            for c in range(2):
                for j, v in full:
                    g[j][c] += v * (e[c] / e.sum() - (c == y))
        for i in range(4):
            for c in range(2):
                z[i][c] += g[i][c] - ((n[i][c] + g[i][c] ** 2) ** 0.5 - n[i][c] ** 0.5) / alpha * w[i][c]
                n[i][c] += g[i][c] ** 2
    old, langid._BATCH = langid._BATCH, 2
    try:
        got, bias = langid.fit_ftrl(rows, 3, 2, epochs=1)
    finally:
        langid._BATCH = old
    assert np.allclose([*got, bias], [[weight(i, c) for c in range(2)] for i in range(4)])


def test_repeated_rows_clashing_columns_and_no_ids(spark):
    rows = [(None, "en" if i % 2 else "de", "the cat and the dog" if i % 2 else "der Hund und die Katze", "x", 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string, score double")
    got = langid.identify(df, per_language=20)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.groupBy("lang_pred").count().count() == 2 and got.count() == 400
    model = langid.fit(df)
    kept = langid.with_language(df.withColumn("lang", langid.F.lit(None).cast("string")), model, languages=["en"])
    assert kept.columns == df.columns and {(r.text[:3], r.lang) for r in kept.collect()} == {("the", "en")} and kept.count() == 200


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} <= {"und", "en"}
    assert langid.identify(df.where("doc_id > 5")).count() == 0
