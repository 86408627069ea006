import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import divergence, oracles
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string"


def data():
    r = random.Random(6)
    common = ["the", "of", "and", "to", "in", "Über", "é"]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ".", ","]) for _ in range(n))
    rows = [(i, prose(r.randrange(1, 400)), r.choice(["en", "fr", None])) for i in range(160)]
    line = prose(12)
    rows += [
        (200, "\n".join([line] * 9 + ["", " ", prose(30)]), "en"),
        (201, " ".join(f"{w.upper()}!!" for w in prose(120).split()), "en"),
        (202, " | ".join(f"x{i}" for i in range(150)), "en"),
        (203, prose(100) + "\t#$%&*<>|\x0b" + prose(50), "rare"),
        (204, "one " * 30, "en"), (205, "a b c d e f g h", "en"), (206, "a b c d e f g h a b c d e f g h", "en"),
        (207, None, "en"), (207, "", "en"), (None, "   \n\t", None), (208, prose(3000), "en"), (208, prose(3000), "en"), (209, "日本語 " * 60, "en"), (210, "x\x00y \x1c z\x85w", "en"),
    ]
    return rows


def test_matches_sql(spark):
    df = spark.createDataFrame(data(), SCHEMA).repartition(3)
    more = df.selectExpr("*", "1 as words", "2 as n_words", "3 as t", "4 as of_lang")
    n = same(divergence.judged(more), oracles.DIVERGENCE, tables={"documents": df.toPandas().astype({"doc_id": "Int64"})})
    assert n == len(data())


def test_common_words_are_found_by_hash(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, k) for i, t, k in data() if i is not None], SCHEMA)
    refs = divergence.references(df)
    out = divergence.distances(divergence.statistics(df), refs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
    monkeypatch.setattr(divergence, "MOST_LISTED", 3)  # more words than that: each meets those of its language
    rows = lambda x: sorted(map(tuple, x.select("doc_id", "n_repeat_words", "word_distance").collect()), key=str)
    assert rows(out) == rows(divergence.distances(divergence.statistics(df), refs))


def repeated(words, k=8):
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    twice = {g for g, n in Counter(runs).items() if n > 1}
    return len({q for i, g in enumerate(runs) if g in twice for q in range(i, i + k)})


def test_repeated_runs_against_brute_force(spark):
    r = random.Random(2)
    texts = [[r.choice("ab") for _ in range(r.randrange(0, 40))] for _ in range(300)] + [list("abcdefgh") * 2, ["x"] * 3000, [str(i) for i in range(3000)] * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>")
    got = dict(df.select("i", divergence.n_repeated(F.col("w"))).collect())
    assert got == {i: repeated(t) for i, t in enumerate(texts)}


def test_verdicts(spark):
    rows = {r.doc_id: r for r in divergence.judged(spark.createDataFrame([r for r in data() if r[0] is not None], SCHEMA)).collect()}
    assert not rows[201].kept and not rows[201].base_failed  # upper case
    assert not rows[202].kept and not rows[202].base_failed  # a list with bars
    assert rows[203].kept and rows[203].class_distance is None  # a language with few words has no reference
    assert rows[204].base_failed and rows[205].base_failed and rows[207].base_failed
    clean = [rows[i] for i in range(160) if rows[i].n_words >= 20]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_distance_ends(spark):
    a, b = [0.25, 0.75, 0.0], [0.0, 0.0, 1.0]
    one = spark.range(1).select(*[F.array(*map(F.lit, x)).alias(n) for n, x in (("a", a), ("b", b))])
    assert tuple(one.select(divergence.js_distance(F.col("a"), F.col("a")), divergence.js_distance(F.col("a"), F.col("b"))).first()) == (0.0, 1.0)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = divergence.judged(df)
    assert out.count() == 0
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))


@pytest.mark.parametrize("quality", [0, 1])
def test_labelled_documents(spark, quality):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.col("quality") == quality).select(F.col("doc_id").alias("label_id"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = divergence.judged(docs).join(labels, F.col("doc_id") == F.col("label_id")).where("not base_failed and n_words >= 50")
    share = found.agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share >= 0.98 if quality else share <= 0.2
