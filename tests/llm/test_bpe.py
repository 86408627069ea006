import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessella.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH)[0], special_tokens={})


def unpack(ids):
    return list(memoryview(ids).cast("I")) if ids else []


def texts():
    r = random.Random(2)
    out = ["", "Hello  world's\n\n tabs\t\tand   spaces ", "a" * 20_000, "ab" * 5000 + "!" * 3000, "naïve Ünïcode 🙂🙂 中文字符", "<|endoftext|> is text", "  x \r\n", "0123456789" * 400]
    out += ["".join(r.choices("abcde thERÉß12'!\n ", k=r.choice([3, 50, 900]))) for _ in range(150)]
    return out + ["".join(r.choices("ab", k=3000)), "=" * 9999 + " " * 500, "the" * 4000]


def test_ids_are_those_of_the_library(library):
    for t in texts():
        ids = bpe.encode(t, PATH, PATTERN)
        assert unpack(ids) == library.encode_ordinary(t)
        assert bpe.decode(ids, PATH) == t.encode()


def test_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(path)[0], special_tokens={})
    for t in texts()[:40]:
        assert unpack(bpe.encode(t, path, PATTERN)) == enc.encode_ordinary(t)


def test_merges_match_a_plain_search():
    r = random.Random(4)
    tokens = [bytes([c]) for c in b"abc"]
    while len(tokens) < 700:
        t = r.choice(tokens) + r.choice(tokens)
        if t not in tokens and len(t) < 9:
            tokens.append(t)
    r.shuffle(tokens)
    ranks = {t: i for i, t in enumerate(tokens)}
    for _ in range(300):
        piece = bytes(r.choices(b"aab" if r.random() < 0.3 else b"abc", k=r.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1 and piece not in ranks:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_frames(spark):
    rows = [(i, t, 1) for i, t in enumerate([*texts()[:20], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.digests(df, PATH, PATTERN, keep_ids=True).collect()}
    for i, t, _ in rows:
        ids = bpe.encode(t, PATH, PATTERN)
        assert got[i].n_tokens == len(ids) // 4 and got[i].ids == unpack(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(df, PATH, PATTERN), PATH)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {i: t or "" for i, t, _ in rows}
    assert bpe.digests(df.where("doc_id < 0"), PATH, PATTERN).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (None, "some text", "y"), (2, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 as key", "2 as value", "3 as n_tokens")
    out = bpe.digests(df, PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 2), (1, 2), (1, 2), (2, 0)] and len({r.ids_sha256 for r in out}) == 2
