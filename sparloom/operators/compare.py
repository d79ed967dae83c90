"""Infinity-norm errors between two dense results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, a, b): arrays of both results (row, x) side by side; a missing row or element is 0."""
    both = a.select("row", F.col("x").alias("a")).join(b.select("row", F.col("x").alias("b")), "row", "full")
    none = F.array().cast("array<double>")
    pairs = F.zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda p, q: F.struct(F.coalesce(p, F.lit(0.0)).alias("a"), F.coalesce(q, F.lit(0.0)).alias("b")))
    return both.select("row", pairs.alias("pairs"))


def error_norms(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (abs_error, rel_error): the largest difference, and the largest by the greater magnitude of its pair (by 1
    where both are 0). NaN, where there is one, is the result; without elements both are 0."""
    gap = lambda p: F.abs(p["a"] - p["b"])

    def relative(p):
        top = F.greatest(F.abs(p["a"]), F.abs(p["b"]))
        return gap(p) / F.when(top == 0, F.lit(1.0)).otherwise(top)

    worst = align(a, b).select(F.array_max(F.transform("pairs", gap)).alias("g"), F.array_max(F.transform("pairs", relative)).alias("r"))
    return worst.agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("abs_error"), F.coalesce(F.max("r"), F.lit(0.0)).alias("rel_error"))
