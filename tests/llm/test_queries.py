import pytest

from tessella.llm import queries
from tessella.session import table
from tests.compare import same
from tests.llm import test_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op7_token_counts": ["doc_id", "n_words", "n_tokens"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_every_row(spark, name):
    out = queries.queries()[name](spark, SF)
    source = table(spark, SF, "pages" if name.startswith("op8") else "documents")
    assert out.columns == COLUMNS[name] and out.count() == source.count()


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {tuple(r) for r in queries.op5_simhash_near_dedup(spark, SF).collect()}
    assert got == test_simhash.brute(rows)


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
