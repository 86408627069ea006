import random

from tessella.llm import chat, oracles
from tests.compare import same

SCHEMA = "conv_id long, turn long, role string, text string"


def data():
    r = random.Random(8)
    rows, k = [], 0
    for _ in range(12):
        base = [(t, "user" if t % 2 == 0 else "assistant", r.choice(["hi", "yes", "", None, "Ünïcode 🙂", "long " * 50])) for t in range(r.randrange(1, 7))]
        base[0] = (0, "system", r.choice("ab"))
        for n in {len(base), *r.choices(range(1, len(base) + 1), k=3)}:
            for _ in range(r.choice([1, 1, 3])):
                rows += [(k, *t) for t in base[:n]]
                k += 1
    rows += [(k, t, "user", f"turn {t}") for t in range(700)] + [(k + 1, t, "user", f"turn {t}") for t in range(300)]
    rows += [(k + 2, 0, "user", "same"), (k + 2, 0, "user", "same"), (k + 2, 0, None, "same"), (None, 0, "user", "x"), (k + 3, None, "user", "x"), (k + 4, 0, "user", None), (k + 5, 0, "user", "")]
    return rows


def test_matches_sql(spark):
    df = spark.createDataFrame(data(), SCHEMA).repartition(3)
    n = same(chat.formatted(df), oracles.CHAT, tables={"conversations": df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})})
    assert n > 10


def test_real_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(chat.formatted(spark.read.parquet(f"{sf}/conversations.parquet")), oracles.CHAT, sf)


def test_planted_snapshots(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "c")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: (2, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"),
        4: (2, 1, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"),
    }


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.formatted(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    more = df.union(df).selectExpr("*", "'x' as chunk", "1 as a", "2 as b", "3 as kept_id", "4 as n_turns", "5 as part")
    assert sorted(chat.formatted(more).collect()) == sorted(chat.formatted(df).collect())
