"""Matrices and multivectors over order, event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the vectors table.
VECTOR = 64
#: Rows of the vectors table.
VECTORS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(df: DataFrame, row: str, col: str, val) -> DataFrame:
    return df.select(F.expr(row).cast("long").alias("row"), F.expr(col).cast("long").alias("col"), val.cast("double").alias("val"))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts: quantities. Has duplicates and empty rows."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_quantity"))


def order_part_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts: tax in hundredths, zeros stored."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.round(F.col("l_tax") * 100))


def order_part_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts: discount in hundredths, zeros stored."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.round(F.col("l_discount") * 100))


def order_part_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts, where the first two lines of every order are for part 0: one column has about half of all entries."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "if(l_linenumber <= 2, 0, l_partkey)", F.col("l_quantity"))


def order_part_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parts: what was paid, in numbers that are not whole."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))


def part_prices(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(row, x): the parts' prices by 3, 4, ... k + 2."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda z: F.col("p_retailprice") / (z + 3)).alias("x"))


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by parts: a few long rows."""
    return _entries(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_quantity"))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", F.col("l_quantity"))


def lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored half of a symmetric matrix."""
    return _entries(table(spark, sf_dir, "lineitem"), "greatest(l_suppkey, l_partkey % 100)", "least(l_suppkey, l_partkey % 100)", F.col("l_quantity"))


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by events: a pattern."""
    return _entries(table(spark, sf_dir, "events"), "user_id", f"event_id % {VECTORS}", F.lit(1.0))


def part_vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(row, x): integer-valued multivector over the parts."""
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.cast("long").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda z: size + z * (key % 7)).alias("x"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, x): the vectors, in whole 2**-20ths."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("row"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 1048576.0).cast("double")).alias("x"))


def count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def extent(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """One more than the largest key."""
    return int(table(spark, sf_dir, name).agg(F.max(key)).first()[0] or 0) + 1
