import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.plans import bindings as T
from tessella.plans import catalogue
from tests.compare import same

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_rasters(tmp_path):
    """Four rows of each table on more rasters than are broadcast, in a file of some KB."""
    ids, some = list(range(12_000)), [3, 5_000, 11_999, 26_000]
    tables = {
        "supplier": {"s_suppkey": ids},
        "events": {"event_id": some, "event_type": ["click"] * 4, "value": [1.0] * 4, "props": ["{}"] * 4},
        "orders": {"o_orderkey": some, "o_orderpriority": ["LOW"] * 4},
        "customer": {"c_custkey": some},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_many_rasters_are_never_broadcast(spark, many_rasters):
    for f in (T.labels, T.truth, T.points, catalogue.QUERIES["tile_label_translated"]):
        text = plan(f(spark, many_rasters))
        assert "Broadcast" not in text and "SortMergeJoin" in text
    assert sorted(r.raster_id for r in T.labels(spark, many_rasters).select("raster_id").collect()) == [3, 2_000, 5_000, 11_999]


def test_few_rasters_are_no_keys_of_a_shuffle(spark):
    for f in (T.labels, T.truth, T.points):
        assert "Exchange hashpartitioning" not in plan(f(spark, SF))


@pytest.mark.parametrize("name", ["tile_label_translated", "tile_label_overlap", "match_iou", "cloud_tile_points"])
def test_many_rasters_give_the_rows_of_the_sql(spark, monkeypatch, name):
    monkeypatch.setattr(T, "FEW_RASTERS", 0)
    assert same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) > 0
