import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessella.llm import bpe
from tessella.session import table
from tests.llm import test_decontaminate, test_secrets, test_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage over the small table with planted cases."""
    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").first()
    item = table(spark, SF, "benchmark").orderBy("item_id").first()
    planted = [
        (5001, None, None, "p", None),
        (5002, "123 !!", "en", "p", 6),
        (5003, first.text, "en", "p", first.n_chars),
        (5004, item.text, "en", "p", len(item.text)),
        (5005, "the and of that with this are from token=abcdefgh12345 was here", "en", "p", 63),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    out = [{r.doc_id: r for r in docs.collect()}]
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, SF), "step")
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_language_id_keeps_what_is_in_a_learned_language(stages):
    assert set(stages[0]) - set(stages[1]) == {i for i, r in stages[0].items() if not any(c.isalpha() for c in r.text or "")} >= {5001, 5002}
    assert all(r == stages[0][i] for i, r in stages[1].items())


def test_language_id_decides_by_language_and_confidence(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    bare = docs.withColumn("lang", corpus_pipeline.F.when(corpus_pipeline.F.col("doc_id") % 3 != 0, corpus_pipeline.F.col("lang")))
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", frozenset({"en", "de"}))
    rows = corpus_pipeline.language_id(spark, bare, SF).collect()
    wanted = {i for i, x in langs.items() if x in ("en", "de")}
    # a letter test would keep every row; predictions may err on a few very short texts
    assert len({r.doc_id for r in rows} ^ wanted) <= 0.02 * len(langs) < len(langs) - len(wanted)
    assert sum(r.lang == langs[r.doc_id] for r in rows) >= 0.98 * len(rows) and all(r.lang for r in rows)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 0


def test_near_dedup_keeps_one_of_each_group(stages):
    groups = test_simhash.brute([(i, r.text) for i, r in stages[1].items()])
    assert set(stages[2]) == {i for i, _, g in groups if i == g}
    assert 5003 not in stages[2]


def test_decontamination_drops_the_contaminated(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, x in test_decontaminate.brute([(i, r.text) for i, r in stages[2].items()], items).items() if x[4]}
    assert set(stages[3]) == set(stages[2]) - bad and 5004 in bad


def test_secrets_are_masked_and_the_rest_unchanged(stages):
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[3].items():
        if sum(test_secrets.brute(r.text)[:3]) == 0:
            assert stages[4][i] == r
        else:
            assert sum(test_secrets.brute(stages[4][i].text)[:3]) == 0 and stages[4][i].n_chars == len(stages[4][i].text)
    assert "token=[REDACTED] was" in stages[4][5005].text


def test_encoding(stages):
    ranks = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))[0]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(stages[5]) == set(stages[4])
    for i, r in stages[4].items():
        assert stages[5][i].ids == enc.encode_ordinary(r.text)
        assert stages[5][i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_and_repeated_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5)], table(spark, SF, "documents").schema)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "None"]


def test_stages_on_an_empty_table_and_without_languages(spark):
    docs = table(spark, SF, "documents")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("doc_id < 0"), SF).count() == 0
    unlabelled = docs.limit(5).withColumn("lang", corpus_pipeline.F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == 5


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, "a", "b", 1), (7, "Das ist ein Text ohne Besonderes", "de", None, None, "a", "b", 1)],
        "doc_id long, text string, lang string, source string, n_chars long, text_in string, extra_id string, score int",
    )
    for name, f in corpus_pipeline.STAGES[1:4]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 2, name
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 1
    assert corpus_pipeline.byte_bpe(spark, docs, SF).count() == 2


def test_different_texts_that_share_an_id_both_stay(spark):
    one, two, three = ("the cat sat on a mat", "seven green bottles hang there", "nobody expects such a long winter")
    docs = [(1, one), (2, two), (2, one), (3, three), (3, three), (3, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], table(spark, SF, "documents").schema)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == [(1, one), (2, two), (3, three)]
    same_id = docs.where("doc_id <> 1").where(f"text <> '{one}'").withColumn("doc_id", corpus_pipeline.F.lit(3).cast("long"))
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, same_id, SF).collect()) == sorted([two, three])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (3, "", "en", "s", 0)]])
def test_empty_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns
