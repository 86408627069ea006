import random

import public_tokenizers
import regex

from tessella.llm import wordpiece as wp

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    word += wp.END
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces or word[i:j] == wp.END), None)
        if j is None:
            return 1
        n += word[i:j] != wp.END
        i = j
    return n


def test_small_vocabularies_match_greedy_search():
    r = random.Random(6)
    for _ in range(60):
        pieces = {"".join(r.choices("abc", k=r.randrange(1, 6))) + r.choice(["", wp.END]) for _ in range(r.randrange(1, 14))}
        m = wp.Matcher(sorted(pieces))
        for _ in range(120):
            word = "".join(r.choices("abcd" if r.random() < 0.1 else "abc", k=r.randrange(1, 12)))
            assert m.count(word + wp.END) == greedy(word, pieces), (word, pieces)


def test_public_vocabulary_matches_greedy_search(spark):
    pieces, spelling = set(wp.vocabulary(PATH)), wp._bytes_as_chars()
    r = random.Random(7)
    texts = [None, "", " \n", "The cat's 42 dogs!?! naïve ÜBER 中文", "z" * 3000 + " end"] + [" ".join("".join(r.choices("etaoinshrdé", k=r.randrange(1, 14))) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wp.token_counts(df, PATH).collect()}
    for i, t in enumerate(texts):
        words = regex.findall(wp.WORDS, (t or "").lower())
        assert got[i] == (len(words), sum(greedy("".join(spelling[b] for b in w.encode()), pieces) for w in words))
    assert wp.token_counts(df.where("doc_id < 0"), PATH).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "one")], "doc_id long, text string").selectExpr("*", "1 as key", "2 as n_words", "3 as n_tokens")
    assert sorted((r.doc_id or 0, r.n_words) for r in wp.token_counts(df, PATH).collect()) == [(0, 1), (1, 2), (1, 2)]
