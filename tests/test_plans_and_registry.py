"""Plans that scale, and the registry that the driver reads."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparloom.jobs import bindings as B
from sparloom.jobs.queries import REGISTRY
from sparloom.jobs.sql import ORACLE
from sparloom.operators import entries, layouts, prefix, product

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier", "events", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_same_as_sql(spark, con, name):
    got, want = REGISTRY[name](spark, SF), con.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 6000


def test_scan_reads_needed_columns_only(spark):
    text = plan(product.spmm(B.order_part(spark, SF), B.part_vectors(spark, SF, 4), 1500, 4, 200))
    assert "l_quantity" in text and "l_comment" not in text and "l_tax" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BroadcastHashJoin" in text


def test_unknown_size_is_not_broadcast_by_hint(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(product.spmm(B.order_part(spark, SF), B.part_vectors(spark, SF, 4), 1500, 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="broadcast"):
        product.spmm(B.order_part(spark, SF), B.part_vectors(spark, SF, 4), 1500, 4, 10**8, strategy="broadcast")


def test_layout_product_shuffles_once_for_join_and_sum(spark):
    rows = layouts.grouped_rows(B.order_part(spark, SF), 1500)
    text = plan(product.spmm(layouts.from_layout(rows), B.part_vectors(spark, SF, 4), 1500, 4, 200, complete=False))
    assert text.count("Exchange hashpartitioning") <= 2  # entries by row, and the range of rows


def test_running_sums_meet_as_bucket_totals_only(spark):
    text = plan(prefix.row_pointers(entries.all_row_nnz(B.order_part(spark, SF), 1500), 1500))
    assert text.count("SinglePartition") == 1
    at = text.index("SinglePartition")
    assert "_total" in text[at - 400 : at + 400] or "HashAggregate" in text[at : at + 400]
