import random

import xxhash

from tessella.llm import simhash
from tessella.operators.components import connected_components


def brute_print(text):
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    for c in b"\t\n\v\f\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = {i: brute_print(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, f"{prints[i]:016x}", find(i)) for i in prints}


def corpus():
    r = random.Random(3)
    vocab = ["Ä" + str(i) if i % 7 == 0 else f"Word{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 40, 700]))
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((k, " ".join(copy) if k % 3 else "\t".join(copy)))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \x0b\n"), (k + 3, "a b C"), (k + 4, "word " * 5000)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_large_buckets_are_split_without_loss(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        x = r.choice(sorted(prints)) if len(prints) % 2 else centre
        for _ in range(r.choice([1, 2, 5])):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    reps = spark.createDataFrame([((p + 2**63) % 2**64 - 2**63, i) for i, p in enumerate(prints)], "fp long, node long")
    got, tiled = ({(r.node, r.component) for r in connected_components(simhash.links(reps, bucket_rows=n, tile=8, blocks=b)).collect()} for n, b in ((16, True), (150, False)))
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    roots = [find(i) for i in range(len(prints))]
    assert got == tiled == {(i, x) for i, x in enumerate(roots) if roots.count(x) > 1}


def test_more_blocks_for_more_rows():
    for n, blocks in ((1000, 4), (2**34, 5)):
        cut, choices = simhash._block_choices(n, 3, 16_384)
        assert len(cut) == blocks and sum(w for _, w in cut) == 64
        assert all(len(c) == blocks - 3 for c in choices)


def test_components_on_a_long_path_and_empty(spark):
    path = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(path.where("a < 0")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q w e r t")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1)]


def planted(spark, monkeypatch, rows):
    """Rows ``(doc_id, text)`` whose text is their fingerprint in hexadecimal."""
    prints = spark.createDataFrame(rows, "doc_id long, text string")
    own = lambda d, i="doc_id", t="text", **more: d.select(i, *[c.alias(n) for n, c in more.items()], simhash.F.conv(t, 16, 10).cast("long").alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", own)
    return prints


def test_a_text_without_id_links_and_bridges(spark, monkeypatch):
    # 1 and 9 lie six bits apart, three from the text without id; the last two lack ids altogether
    rows = [(1, "3f000"), (9, "0"), (None, "7000"), (None, "3f000"), (None, "fff00000"), (None, "fff00001")]
    got = simhash.near_duplicates(planted(spark, monkeypatch, rows))
    want = [(i, t.zfill(16), None if t.startswith("fff") else 1) for i, t in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_one_copy_without_id_stays_of_a_component(spark, monkeypatch):
    rows = [(1, "3f000"), (9, "0"), (None, "7000"), *[(None, "3f000")] * 3, *[(None, "fff00000")] * 5, (None, "fff00001"), (4, "ffffffffff")]
    got = [tuple(r) for r in simhash.without_copies(planted(spark, monkeypatch, rows)).collect()]
    named, unnamed = ([r for r in got if (r[0] is None) == lacks] for lacks in (False, True))
    assert sorted(named) == [(1, "3f000"), (4, "ffffffffff")]
    assert sorted(t.startswith("fff0") for _, t in unnamed) == [False, True]
