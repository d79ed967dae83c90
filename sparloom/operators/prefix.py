"""Running sums over a whole table without a one-task window over it.

Keys are cut into buckets of `width`; the totals of the buckets, about the square root of the keys in number, are summed up
and each bucket is then summed on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.shared import checkpoint

LEAST_WIDTH = 1024
#: Rows of a broadcast table of counts at most; a row has a key, a number of a range and two counts.
COUNTS = 100_000


def bucket_width(keys: int) -> int:
    """Width that makes buckets and keys in a bucket about equal in number."""
    return max(LEAST_WIDTH, math.isqrt(max(keys, 0)))


def bucket_starts(df: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """(_bucket, _start): the sum of all values in earlier buckets. One row per bucket is all that meets in one task."""
    totals = df.groupBy((F.floor(F.col(key) / width)).cast("long").alias("_bucket")).agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str, width: int) -> DataFrame:
    """df with `out`: the sum of `value` over all rows with a smaller key. Keys are unique, non-negative numbers."""
    starts = bucket_starts(df, key, value, width)
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_bucket", F.floor(F.col(key) / width).cast("long"))
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, "_bucket").withColumn(out, F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")


def row_pointers(nnz: DataFrame, m: int) -> DataFrame:
    """(row, irp) for rows 0 to m of the counts (row, nnz) of rows 0 to m - 1: where each row's entries begin; the last
    is the number of entries."""
    padded = nnz.select("row", "nnz").union(nnz.sparkSession.range(m, m + 1).select("id", F.lit(0).cast("long")))
    return prefix_sum(padded, "row", "nnz", "irp", bucket_width(m)).select("row", "irp")


def hack_offsets(directory: DataFrame, hacks: int) -> DataFrame:
    """(hack, hack_offset) for hacks 0 to `hacks`; the last is the padded size."""
    sized = directory.select("hack", (F.col("n_rows") * F.col("maxnz")).alias("size"))
    padded = sized.union(directory.sparkSession.range(hacks, hacks + 1).select("id", F.lit(0).cast("long")))
    return prefix_sum(padded, "hack", "size", "hack_offset", bucket_width(hacks)).select("hack", "hack_offset")


def places(df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None, overall: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with `out` long: a row's place, from 0, among the rows of its keys by `order`; `total`: how many these are; and `overall`: its
    place among all rows by keys and order.

    Numbering has two levels, so that one key may have any share of the rows. Rows are dealt by ranges of keys and order, equal in
    number whatever the keys, and sorted inside; Spark numbers a range's rows one after another. A range holds a key's rows
    in one stretch: a count for each key and range gives where the stretch begins in the range and, by a running sum over the
    key's ranges, in the key. There is no window over the rows of a key, and the counts are keys and ranges in number at most.
    Rows with equal keys and order are numbered in any order; keys must not be null. No keys: places in the whole table.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    rows = checkpoint(dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_range")
    counts = rows.groupBy(*keys, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy(*keys)
    upto = lambda w: F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpoint(counts.select(*keys, "_range", (upto(inside) - F.col("_first")).alias("_by"), F.sum("_rows").over(inside).alias("_all")))
    found = rows.withColumn("_range", part).join(_small(starts), [*keys, "_range"]).withColumn(out, F.col("_at") + F.col("_by"))
    if overall:
        ranges = rows.groupBy(part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        ranges = checkpoint(ranges.select("_range", (upto(Window.partitionBy()) - F.col("_first")).alias("_before")))  # a row for each range
        found = found.join(_small(ranges), "_range").withColumn(overall, F.col("_at") + F.col("_before"))
    return found.select(*df.columns, out, *([F.col("_all").alias(total)] if total else []), *([overall] if overall else []))


def _small(counts: DataFrame) -> DataFrame:
    return F.broadcast(counts) if counts.count() <= COUNTS else counts
