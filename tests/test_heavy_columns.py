"""Products with columns that hold any share of the entries, with Spark's own skew handling off."""

import pytest
from pyspark.sql import functions as F

from sparloom.operators import product

PARTS = 16


@pytest.fixture(scope="module")
def hot(spark):
    """90,000 entries in 1,000 rows: column 5 has a third, columns 6 and 7 a tenth each, the rest are even."""
    i = F.col("id")
    col = F.when(i % 3 == 0, 5).when(i % 10 == 1, 6).when(i % 10 == 2, 7).otherwise(F.pmod(i * 48271, F.lit(5000)) + 10)
    return spark.range(90_000).select(F.pmod(i * 16807, F.lit(1000)).alias("row"), col.cast("long").alias("col"), (i % 7 + 1).cast("double").alias("val"))


@pytest.fixture(scope="module")
def x(spark):
    return spark.range(5_010).select(F.col("id").alias("row"), F.array(*[(F.col("id") * (z + 1) % 11).cast("double") for z in range(3)]).alias("x"))


@pytest.fixture
def plain_shuffles(spark):
    changed = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(PARTS)}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_heavy_columns(hot):
    assert product.heavy_columns(hot, PARTS)[0] == 5 and set(product.heavy_columns(hot, PARTS)) == {5, 6, 7}
    assert product.heavy_columns(hot, 5) == [5] and product.heavy_columns(hot, 2) == []
    assert product.heavy_columns(hot.where("row < 0"), PARTS) == []
    assert set(product.heavy_columns(hot, PARTS, 2)) <= {5, 6, 7}


def test_no_partition_passes_twice_the_mean(spark, hot, x, plain_shuffles):
    heavy = product.heavy_columns(hot, PARTS)
    dealt = {r["p"]: r["count"] for r in hot.where(~F.col("col").isin(heavy)).groupBy(F.pmod(F.hash("col"), F.lit(PARTS)).alias("p")).count().collect()}
    assert max(dealt.values()) <= 2 * 90_000 / PARTS
    every = {r["p"]: r["count"] for r in hot.groupBy(F.pmod(F.hash("col"), F.lit(PARTS)).alias("p")).count().collect()}
    assert max(every.values()) > 4 * 90_000 / PARTS  # what a plain join would do

    y = product.spmm(hot, x, 1000, 3, 5_010, strategy="split")
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    want = {r["row"]: r["x"] for r in product.spmm(hot, x, 1000, 3, 5_010, strategy="shuffled").collect()}
    assert {r["row"]: r["x"] for r in y.collect()} == want


def test_too_large_for_a_broadcast_is_split(spark, hot, x, plain_shuffles, monkeypatch):
    monkeypatch.setattr(product, "BROADCAST_BYTES", 40_000)
    y = product.spmm(hot, x, 1000, 3, 5_010)
    assert "SortMergeJoin" in y._jdf.queryExecution().executedPlan().toString()
    got = {r["row"]: r["x"] for r in y.collect()}
    monkeypatch.undo()
    assert got == {r["row"]: r["x"] for r in product.spmm(hot, x, 1000, 3, 5_010).collect()}
    wide = {r["row"]: r["x"] for r in product.spmm(hot, x, 1000, 3, 5_010, strategy="split").collect()}
    assert wide == got


def test_even_columns_are_joined_by_one_shuffle(spark, hot, x, plain_shuffles):
    even = hot.where("col >= 10")
    plan = product.spmm(even, x, 1000, 3, 5_010, strategy="split")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Union" not in plan
