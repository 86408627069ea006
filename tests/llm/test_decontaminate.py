import hashlib
import random

from tessella.llm import decontaminate as dc
from tessella.llm import oracles
from tests.compare import same


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = dc.words_of(t.encode() if t else None)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = dc.words_of(t.encode() if t else None)
        hit, found = set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if who := wins.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= who
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(2, 30)]
    items += [(40, "Ünique Wörd, here!"), (41, None), (42, items[5][1]), (43, "w1 " * 40)]
    docs = []
    for d in range(60):
        w = r.choices([*vocab, "zz", "yy"], k=r.choice([0, 5, 40, 400]))
        for _ in range(r.choice([0, 1, 3])):
            w[r.randrange(len(w) + 1) : 0] = (r.choice(items)[1] or "").split()
        docs.append((d, " ".join(w).upper() if d % 2 else "-".join(w)))
    return [*docs, (100, None), (101, ""), (102, "xünique wörd here"), (103, "say ünique, wörd\x00HERE; now"), (104, "w1 " * 9000)], items


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_one_and_many_blocks_match_brute_force(spark):
    docs, items = data()
    for kept in (items, [x for x in items if x[1] and len(x[1].split()) >= 13]):
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame(kept, "item_id long, text string")
        want = brute(docs, kept)
        assert rows(dc.contamination(d, b)) == want
        assert rows(dc.contamination(d, b, block_words=40)) == want


def test_matches_sql(spark):
    docs, items = data()
    docs = [x for x in docs if x[0] != 103]  # DuckDB's patterns stop at a zero byte
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    same(dc.contamination(d, b), oracles.CONTAMINATION, tables={"documents": d.toPandas(), "benchmark": b.toPandas()})


def test_spans_are_cut_only_at_the_coverage_limit(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = [(1, f"Before it, {item}! After it."), (2, "x " * 500 + item), (3, "clean text"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_cut) for r in dc.without_spans(d, b).collect()}
    assert got == {1: ("Before it, ! After it.", 20), 2: (docs[1][1], 0), 3: ("clean text", 0), 4: (None, 0)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in dc.contamination(d, b).collect()] == [False]
    assert dc.contamination(d.where("doc_id > 1"), b).count() == 0


def test_clean_rows_stay_unchanged(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, "s") for i, t in docs] + [(None, items[10][1], "n")], "doc_id long, text string, text_in string")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, r in brute(docs, items).items() if r[4]}
    want = {(i, t, "s") for i, t in docs if i not in bad}
    assert {tuple(r) for r in dc.uncontaminated(d, b).collect()} - {(None, items[10][1], "n")} == want
    assert {tuple(r) for r in dc.uncontaminated(d, b, block_words=60).collect()} - {(None, items[10][1], "n")} == want
    assert dc.uncontaminated(d, b.where("item_id < 0")).count() == d.count()


def test_null_and_repeated_ids_are_judged_by_row_over_any_blocks(spark):
    items = [(i, " ".join(f"b{i}w{k}" for k in range(15))) for i in range(3)]
    texts = [items[0][1], items[1][1], f"{items[0][1]} and {items[2][1]}", "a clean text", "another clean text", "clean too", items[2][1]]
    docs = list(zip([None, None, 7, 7, None, 8, 9], texts, strict=True)) + [(8, "clean too"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, dc.contamination(d, b, block_words=n).collect())) for n in (100, 15))
    assert len(one) == len(docs) and one == many
    hits = [sorted(map(str, dc.benchmark_hits(d, b, block_words=n).collect())) for n in (100, 15)]
    assert hits[0] == hits[1]
    want = sorted(str(x) for x in docs if not x[1] or "clean" in x[1])
    for n in (100, 15):
        assert sorted(str(tuple(r)) for r in dc.uncontaminated(d, b, block_words=n).collect()) == want


def test_spans_of_all_blocks_are_cut_at_once(spark):
    parts = [" ".join(f"p{i}w{k}" for k in range(15)) for i in range(3)]
    meeting = [" ".join(f"m{k}" for k in range(a, a + 20)) for a in (0, 10)]
    items = list(enumerate([*parts, *meeting]))
    rest = "x " * 450
    docs = [
        (1, rest + parts[0] + " y " + parts[1]),  # 30 of 481 words over two blocks, 15 in each
        (2, " ".join(f"m{k}" for k in range(30)) + " end"),  # the second item begins inside the first
        (3, rest + parts[2]),  # 15 of 465: below the limit
        (None, f"{parts[0]} a"),
        (None, "clean"),
        (4, None),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, rest + " y ", 30), (2, " end", 30), (3, docs[2][1], 0), (None, " a", 15), (None, "clean", 0), (4, None, 0)]
    for n in (1000, 20):
        assert sorted(map(str, map(tuple, dc.without_spans(d, b, block_words=n).collect()))) == sorted(map(str, want))
    assert dc.without_spans(d, b.where("item_id < 0")).where("n_cut = 0").count() == len(docs)


def test_items_without_id_and_items_longer_than_a_block(spark):
    r = random.Random(7)
    items = [(None, " ".join(f"n{k}" for k in range(14))), (None, "short one"), (5, " ".join(r.choices(["a", "b", "c"], k=90))), (6, " ".join(f"q{k}" for k in range(200)))]
    docs = [(1, items[0][1] + " x"), (2, "a short one here"), (3, " ".join(items[2][1].split()[30:60])), (4, " ".join(items[3][1].split()[90:140]) + " z" * 900), (5, "nothing"), (1, "nothing")]
    docs += [(k, " ".join(items[3][1].split()[k : k + 13])) for k in range(10, 187)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for n in (1000, 20):
        got = sorted(map(str, dc.contamination(d, b, block_words=n).collect()))
        hits = {(x.doc_id, x.n_words, x.n_hit, x.n_items) for x in dc.contamination(d, b, block_words=n).where("doc_id < 6").collect()}
        assert hits == {(1, 15, 14, 1), (2, 4, 2, 1), (3, 30, 30, 1), (4, 950, 50, 1), (5, 1, 0, 0), (1, 1, 0, 0)}
        assert dc.contamination(d, b, block_words=n).where("doc_id > 9 and n_hit = 13 and n_items = 1").count() == 177
        assert got == sorted(map(str, dc.contamination(d, b).collect()))
    once = d.where("doc_id > 1")
    same(dc.contamination(once, b), oracles.CONTAMINATION, tables={"documents": once.toPandas(), "benchmark": b.toPandas().astype({"item_id": "Int64"})})


def test_repeated_words_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        own = dc.SuffixAutomaton([("a", [b"x"] * n), ("b", [b"x"] * 3)])
        began = time.process_time()
        spans, found = own.matches([b"x"] * n)
        took.append(time.process_time() - began)
        assert spans == [(0, n)] and found == {"a", "b"}
    assert took[1] < 0.5 and took[1] < 12 * max(took[0], 0.005)
