"""Nonzeros as rows (row, col, val): cleaning, counting, completing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebase(coo: DataFrame) -> DataFrame:
    """1-based indices to 0-based ones."""
    return coo.withColumns({"row": F.col("row") - 1, "col": F.col("col") - 1})


def pattern_values(coo: DataFrame) -> DataFrame:
    """Every stored entry counts as 1."""
    return coo.withColumn("val", F.lit(1.0))


def drop_zeros(coo: DataFrame) -> DataFrame:
    """Without explicit zeros, -0.0 among them; NaN stays."""
    return coo.where("val <> 0")


def mirror_symmetric(coo: DataFrame) -> DataFrame:
    """Adds (col, row) for every entry off the diagonal, in one scan of the source; other columns, a file order among
    them, come along."""
    rest = [c for c in coo.columns if c not in ("row", "col")]
    pair = lambda a, b: F.struct(F.col(a).alias("row"), F.col(b).alias("col"))
    both = F.when(F.col("row") == F.col("col"), F.array(pair("row", "col"))).otherwise(F.array(pair("row", "col"), pair("col", "row")))
    return coo.select(F.explode(both).alias("_at"), *rest).select("_at.row", "_at.col", *rest)


def mirror_union(coo: DataFrame) -> DataFrame:
    """The same as a union of two scans, for columnar sources, where a second scan costs less than an explode."""
    swapped = coo.where("row <> col").withColumns({"row": F.col("col"), "col": F.col("row")})
    return coo.unionByName(swapped)


def strip_padding(slots: DataFrame) -> DataFrame:
    """Slots (…, val) of a padded layout without the padding."""
    return slots.where("val <> 0")


def row_nnz(coo: DataFrame) -> DataFrame:
    """(row, nnz) of the rows that have entries; duplicates count one by one."""
    return coo.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))


def complete_rows(df: DataFrame, m: int, fill: dict | None = None) -> DataFrame:
    """df with all rows 0 to m - 1; missing ones take `fill`, by column a Column or a value."""
    out = df.sparkSession.range(m).select(F.col("id").alias("row")).join(df, "row", "left")
    fill = fill or {}
    return out.withColumns({c: F.coalesce(F.col(c), v if hasattr(v, "cast") else F.lit(v)) for c, v in fill.items()}) if fill else out


def all_row_nnz(coo: DataFrame, m: int) -> DataFrame:
    """(row, nnz) of rows 0 to m - 1."""
    return complete_rows(row_nnz(coo), m, {"nnz": F.lit(0).cast("long")})


def empty_rows(coo: DataFrame, m: int) -> DataFrame:
    return coo.sparkSession.range(m).select(F.col("id").alias("row")).join(coo.select("row"), "row", "left_anti")


def max_nnz(coo: DataFrame) -> DataFrame:
    """One row (maxnz): entries of the longest row, 0 without entries."""
    return row_nnz(coo).agg(F.coalesce(F.max("nnz"), F.lit(0)).alias("maxnz"))


def adjusted_nz(stored: DataFrame, symmetric: bool, pattern: bool = False) -> DataFrame:
    """One row (nz) for stored entries: zeros taken off (not of a pattern), mirrored entries added; one pass."""
    kept = F.lit(1) if pattern else (F.col("val") != 0).cast("int")
    times = 1 + (F.col("row") != F.col("col")).cast("int") if symmetric else F.lit(1)
    return stored.agg(F.coalesce(F.sum((kept * times).cast("long")), F.lit(0)).alias("nz"))


def row_major(coo: DataFrame, partitions: int | None = None) -> DataFrame:
    """Entries dealt by ranges of rows and sorted inside them, by file order where there is one."""
    order = ["row", "seq"] if "seq" in coo.columns else ["row", "col", "val"]
    dealt = coo.repartitionByRange(partitions, "row") if partitions else coo.repartitionByRange("row")
    return dealt.sortWithinPartitions(*order)


def to_long(x: DataFrame) -> DataFrame:
    """(row, x array) to (row, z int, val)."""
    return x.select("row", F.posexplode("x").alias("z", "val"))


def to_wide(y: DataFrame, k: int) -> DataFrame:
    """(row, z, val) to (row, x array of k); missing elements are 0."""
    cells = F.map_from_entries(F.collect_list(F.struct("z", "val")))
    return y.groupBy("row").agg(cells.alias("_cells")).select("row", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda z: F.coalesce(F.col("_cells")[z], F.lit(0.0))).alias("x"))
