"""Generated multivectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers and modulus of the generator; all products stay below 2**62.
PRIME, BY_ROW, BY_COLUMN, BY_SEED, STIR = 2_147_483_647, 48_271, 69_621, 16_807, 39_373


def random_multivector(spark: SparkSession, rows: int, k: int, seed: int = 0) -> DataFrame:
    """(row, x array of k): numbers in [0, 1] that depend on row, column and seed alone, however rows are partitioned."""
    row = F.col("id") % PRIME

    def draw(z):
        mixed = (row * BY_ROW + z.cast("long") * BY_COLUMN + F.lit(seed % PRIME) * BY_SEED + 1) % PRIME
        for _ in range(2):
            mixed = (mixed * STIR + F.floor(mixed / 65_536).cast("long") + 1) % PRIME
        return mixed.cast("double") / (PRIME - 1)

    return spark.range(rows).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw).alias("x"))
