import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import oracles, phrases
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string"


def data():
    r = random.Random(4)
    words = ["the", "of", "New", "york", "a", "ß", "日本", "x" * 70, "no.1", " ", "zz"]
    rows = []
    for i in range(500):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(r.randrange(0, 60)))
        rows.append((i, text + "of the new york", r.choice(["en", "de", None, "und"])))
    rows += [(1, "tie tie tie tie tie", "en")] * 40 + [(2, "one two three four", "fr")] * 40 + [(None, None, "en"), (7, "", None), (8, " . ,", "en")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("block_keys", [phrases.BLOCK_KEYS, 5])
def test_matches_sql(spark, block_keys, monkeypatch):
    if block_keys == 5:
        monkeypatch.setattr(phrases, "GROUP_ROWS", 20)  # several slices of a block
        monkeypatch.setattr(phrases, "HELD_ROWS", 8)
        monkeypatch.setattr(phrases, "CHUNK_WORDS", 50)
    df = frame(spark, data())
    assert same(phrases.mined(df, block_keys=block_keys), oracles.PHRASES, tables={"documents": df.toPandas()}) > 10


def test_ties_go_to_the_phrase_and_the_top_is_whole(spark):
    rows = [(i, f"{w}1 {w}2", "en") for w in "dcba" for i in range(30)]
    got = [(r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mined(frame(spark, rows), top=3).orderBy("rank").collect()]
    assert got == [(i, f"{w}1 {w}2", 30, 30, 30, 240, 1_000_000) for i, w in enumerate("abc", 1)]


def test_empty_and_clashing_columns(spark):
    assert phrases.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.mined(frame(spark, [(1, None, "en"), (2, "a b", None)])).count() == 0
    df = frame(spark, data())
    more = df.selectExpr("*", "1 as n", "2 as k1", "'x' as word", "3 as key", "4 as part")
    assert sorted(phrases.mined(more).collect()) == sorted(phrases.mined(df).collect())


def test_long_texts_and_chunk_borders():
    text = b" ".join([b"a b c d e f g"] * 200) + b". a b"
    whole = [w for part in phrases.words_of(text) for w in part]
    for slice_bytes, chunk in ((7, 10), (1 << 20, 1 << 20)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(phrases, "_SLICE_BYTES", slice_bytes)
            m.setattr(phrases, "CHUNK_WORDS", chunk)
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], ["lang", "text"])
            maps = [np.ones(1 << 14, bool)]
            found = Counter()
            for keys in phrases._streams(iter([batch]), 0):
                for own, _ in phrases._phrases(keys, maps, 14, 4):
                    found.update(zip(*(x.tolist() for x in own), strict=True))
            key = phrases._Memo(0)["en"].__getitem__
            want = Counter(tuple(map(key, whole[i : i + k])) for k in (2, 3, 4) for i in range(len(whole) - k + 1) if b"." not in whole[i : i + k])
            assert found == want


def test_perfect_hash():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 50, (4000, 4)).astype(np.uint64), axis=0)
    own = phrases.PerfectHash.loaded(phrases.PerfectHash(keys).dumped())
    assert sorted(own.slots(list(keys.T)).tolist()) == list(range(len(keys)))
    others = keys + np.uint64(1000)
    assert (own.slots(list(others.T)) == -1).all()
    none = phrases.PerfectHash.loaded(phrases.PerfectHash(keys[:0]).dumped())
    assert (none.slots(list(keys.T)) == -1).all()


def test_another_seed_where_keys_collide(spark, monkeypatch):
    words = spark.createDataFrame([("en", b"a", 1), ("en", b"b", 1)], "lang string, word binary, n long")
    real = phrases._key_batches

    def colliding(batches, seed):
        import pyarrow as pa

        for batch in real(batches, seed):
            yield batch if seed else pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([5] * batch.num_rows, pa.int64())], batch.schema.names)

    monkeypatch.setattr(phrases, "_key_batches", colliding)
    keyed, seed = phrases.keyed_words(words.coalesce(1))
    assert seed == 1 and keyed.select("key").distinct().count() == 2


def test_tree_of_sums(spark):
    from functools import partial

    from tessella.llm.trees import LEAVES, tree_sum

    arrays = [np.arange(6) * i for i in range(40)]
    rows = [(i % 2, 3 * i, phrases._packed(a)) for i, a in enumerate(arrays)]
    got = {r.part: phrases._unpacked(bytes(r.value), np.int64).tolist() for r in tree_sum(spark.createDataFrame(rows, LEAVES), partial(phrases._sum_arrays, kind="int64")).collect()}
    assert got == {p: sum(arrays[p::2]).tolist() for p in (0, 1)}
