"""Sizes, padding and operation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.operators.entries import row_nnz


def flops(nz, k: int):
    """Floating-point operations of a product; nz a number or a Column."""
    return 2 * k * nz


def matrix_profile(coo: DataFrame, m: int, n: int) -> DataFrame:
    """One row (m, n, nz, maxnz, avg_nnz rounded up, empty_rows)."""
    stat = row_nnz(coo).agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("nz"), F.coalesce(F.max("nnz"), F.lit(0)).alias("maxnz"), F.count(F.lit(1)).alias("_used"))
    return stat.select(
        F.lit(m).cast("long").alias("m"),
        F.lit(n).cast("long").alias("n"),
        "nz",
        "maxnz",
        F.expr(f"(nz + {m} - 1) div {m}").alias("avg_nnz") if m else F.lit(0).cast("long").alias("avg_nnz"),
        (F.lit(m) - F.col("_used")).cast("long").alias("empty_rows"),
    )


def footprint(coo: DataFrame, directory: DataFrame, m: int, n: int, k: int, dtype: str = "double", blocks: int | None = None) -> DataFrame:
    """One row of bytes: csr, ell, hll (by its directory) and xy (X and Y of k columns); blocks: row blocks listed with csr."""
    value = 8 if dtype == "double" else 4
    p = matrix_profile(coo, m, n)
    h = directory.agg(F.count(F.lit(1)).alias("hacks"), F.coalesce(F.sum(F.col("n_rows") * F.col("maxnz")), F.lit(0)).alias("padded"))
    return p.crossJoin(h).select(  # one row beside one row
        (4 * (m + 1) + (4 + value) * F.col("nz") + 4 * ((blocks or -1) + 1)).alias("csr_bytes"),
        ((4 + value) * m * F.col("maxnz")).alias("ell_bytes"),
        (8 * F.col("hacks") + (4 + value) * F.col("padded")).alias("hll_bytes"),
        F.lit(value * k * (m + n)).cast("long").alias("xy_bytes"),
    )


def padding_ratio(coo: DataFrame, directory: DataFrame, m: int) -> DataFrame:
    """One row (ell_slots, hll_slots, ell_ratio, hll_ratio): slots, and slots for each entry."""
    p = matrix_profile(coo, m, 0)
    h = directory.agg(F.coalesce(F.sum(F.col("n_rows") * F.col("maxnz")), F.lit(0)).alias("hll_slots"))
    ratio = lambda slots: F.try_divide(F.col(slots).cast("double"), F.col("nz").cast("double"))
    return p.crossJoin(h).select((m * F.col("maxnz")).alias("ell_slots"), "hll_slots", "nz").select("ell_slots", "hll_slots", ratio("ell_slots").alias("ell_ratio"), ratio("hll_slots").alias("hll_ratio"))


def throughput(nz: int, k: int, seconds: float) -> float:
    """Billions of floating-point operations a second."""
    return flops(nz, k) / (seconds * 1e9)
