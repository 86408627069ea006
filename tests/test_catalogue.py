import pytest

import __spark_entry__
from tessella.plans import catalogue
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, name):
    assert same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) > 0


@pytest.mark.parametrize("name", ["match_notched", "match_polygons", "mixed_size_overlap", "nms_iou", "nms_notched"])
def test_query_matches_its_sql_on_more_rows(spark, name):
    more = SF.replace("0.001", "0.01")
    assert same(catalogue.QUERIES[name](spark, more), catalogue.ORACLES[name], more) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
