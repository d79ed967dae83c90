"""Products of a sparse matrix and a dense multivector: an equi-join and a grouped sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.operators.entries import complete_rows
from sparloom.operators.layouts import from_layout

#: X is broadcast up to so many bytes; beyond, Spark joins by shuffles and splits skewed columns.
BROADCAST_BYTES = 64 << 20
#: Sums in one aggregation; wider products go by blocks of columns.
BLOCK = 32
#: Columns that are told as heavy at most, and columns that the sketch follows for each of them.
HEAVY, FOLLOWED = 1024, 16


def _zeros(k: int):
    return F.array_repeat(F.lit(0.0), k)


def heavy_columns(coo: DataFrame, parts: int, most: int = HEAVY) -> list[int]:
    """Columns with more entries than one of `parts` partitions should have, `most` of them at most, the heaviest first.

    A sketch of frequent columns, of bounded size in every task, is made in one pass; it never misses a column that has more than
    1 / (FOLLOWED * most) of the entries, and is off by so much at most. Fewer than `parts` columns can be that heavy.
    """
    most = max(1, min(most, parts))
    s = coo.agg(F.expr(f"approx_top_k(col, {most}, {max(FOLLOWED * most, 100)})").alias("top"), F.count(F.lit(1)).alias("nz")).first()
    return [x["item"] for x in s["top"] or [] if x["item"] is not None and x["count"] * parts > s["nz"]]


def _split(coo: DataFrame, x: DataFrame, parts: int, row_bytes: int) -> DataFrame:
    """Entries with their row of x, where neither side fits in memory: entries of heavy columns stay where they are and meet those rows of x
    in a broadcast, at most HEAVY rows and BROADCAST_BYTES; the rest are joined by shuffles, in which no column passes a partition's
    share."""
    heavy = heavy_columns(coo, parts, max(1, min(HEAVY, BROADCAST_BYTES // max(1, row_bytes))))
    rest = x.hint("merge")
    if not heavy:
        return coo.join(rest, "col")
    is_heavy = F.col("col").isin(heavy)
    near = coo.where(is_heavy).join(F.broadcast(x.where(is_heavy)), "col")
    return near.unionByName(coo.where(~is_heavy).join(rest.where(~is_heavy), "col"))


def _joined(coo: DataFrame, x: DataFrame, size: int | None, strategy: str, row_bytes: int) -> DataFrame:
    """Entries with their row of x. size: bytes of x, None if unknown; row_bytes: of one row."""
    small = size is not None and size <= BROADCAST_BYTES and strategy not in ("shuffled", "split")
    if strategy == "broadcast" and not small:
        raise ValueError(f"x must have {BROADCAST_BYTES} bytes at most to be broadcast, and n must tell so; it has {size or 'an unknown number'}")
    x, coo = x.withColumnRenamed("row", "col"), coo.select("row", "col", "val")
    if strategy == "split" or size is not None and not small and strategy != "shuffled":
        return _split(coo, x, int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_bytes)
    return coo.join(F.broadcast(x) if small else x.hint("merge") if strategy == "shuffled" else x, "col")


class _Sums:
    """How products val * x are added up: plainly, or so that the order plays no part.

    Without order each product is cut at fixed powers of two into three whole numbers of GRID bits, by a bound of all products that is the same
    for every partitioning. Whole numbers add up exactly in any order, up to 2**(63 - GRID) of them a row; what lies below the
    last cut, 2**-90 of the bound and less, is left out of each product. The three totals are joined in fixed order.
    """

    GRID = 30

    def __init__(self, top: float | None = None):
        self.units = None
        if top is not None:
            e = math.frexp(top)[1] if math.isfinite(top) else 1024
            # Units are kept away from the ends of the doubles' range.
            self.units = [2.0 ** max(min(e - self.GRID * i, 1000), -1000) for i in (1, 2, 3)]

    def of(self, product: Column, name: str) -> list[Column]:
        """Aggregates that final() joins."""
        if self.units is None:
            return [F.sum(product).alias(f"_{name}")]
        usual = ~(F.isnan(product) | (F.abs(product) == float("inf")))
        rest, cut = F.when(usual, product).otherwise(F.lit(0.0)), []
        for u in self.units:
            whole = F.floor(rest / u)
            cut.append(F.sum(whole))
            rest = rest - whole.cast("double") * u
        odd = F.sum(F.when(~usual, product))  # infinities and NaN, in any order alike
        return [c.alias(f"_{name}_{i}") for i, c in enumerate([*cut, odd])]

    def final(self, name: str) -> Column:
        if self.units is None:
            return F.col(f"_{name}")
        high, middle, low = (F.col(f"_{name}_{i}").cast("double") * u for i, u in enumerate(self.units))
        return (low + middle) + high + F.coalesce(F.col(f"_{name}_3"), F.lit(0.0))


def largest_product(coo: DataFrame, x: DataFrame) -> float:
    """A bound of |val * x|: the largest finite |val| times the largest finite |x|. The same however rows are partitioned."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.abs(c))
    v = coo.agg(F.max(finite(F.col("val")))).first()[0] or 0.0
    w = x.agg(F.max(F.array_max(F.transform("x", lambda e: F.coalesce(finite(e), F.lit(0.0)))))).first()[0] or 0.0
    return v * w


def spmm(coo: DataFrame, x: DataFrame, m: int, k: int, n: int | None = None, strategy: str = "auto", complete: bool = True, dtype: str = "double", exact: bool = False) -> DataFrame:
    """(row, x array of k) = A X for entries (row, col, val) and X as (row, x array of k); duplicates add up.

    n: rows of X, by which its size is checked before it is broadcast; unknown, Spark decides. strategy: "columns" sums
    each column in one aggregation, "blocks" goes by BLOCK columns at a time, "auto" takes blocks beyond BLOCK columns,
    "broadcast" insists on a broadcast, for which n must be given, and "shuffled" on a plain join by shuffles. "split" is a join by
    shuffles for columns of any weight, and what is done where X is known to be too large for a broadcast: entries of columns that would
    fill a partition are left out of the shuffle (see heavy_columns). Partial sums before the shuffle by row absorb long rows. complete: give all m rows, also those without entries. dtype "float" rounds the sums to single
    precision, as read_mm() does the entries. exact: the same bits whatever the partitions, the strategy and the order of entries (see
    _Sums); one more pass over values, and about the time of three products. Without it the last bits depend on the order.
    """
    if strategy not in ("auto", "columns", "blocks", "broadcast", "shuffled", "split"):
        raise ValueError(f"unknown strategy {strategy}")
    size = None if n is None else 8 * n * k
    sums_of = _Sums(largest_product(coo, x) if exact else None)
    if k <= BLOCK and strategy != "blocks" or strategy == "columns":
        joined = _joined(coo, x.select("row", "x"), size, strategy, 8 * k)
        sums = joined.groupBy("row").agg(*[s for z in range(k) for s in sums_of.of(F.col("val") * F.col("x")[z], str(z))])
        y = sums.select("row", F.array(*[sums_of.final(str(z)) for z in range(k)]).alias("x"))
    else:
        cuts = F.array(*[F.struct(F.lit(b).alias("b"), F.slice("x", b * BLOCK + 1, BLOCK).alias("x")) for b in range(-(-k // BLOCK))])
        # The join moves each entry once; its row of x is cut after it.
        joined = _joined(coo, x.select("row", "x"), size, strategy, 8 * k)
        joined = joined.select("row", "val", F.explode(cuts).alias("_c")).select("row", "val", F.col("_c.b").alias("b"), F.col("_c.x").alias("x"))
        sums = joined.groupBy("row", "b").agg(*[s for z in range(BLOCK) for s in sums_of.of(F.col("val") * F.get("x", F.lit(z)), str(z))])
        part = F.struct("b", F.array(*[sums_of.final(str(z)) for z in range(BLOCK)]).alias("x"))
        y = sums.groupBy("row").agg(F.sort_array(F.collect_list(part)).alias("_p"))
        y = y.select("row", F.slice(F.flatten(F.transform("_p", lambda p: p["x"])), 1, k).alias("x"))
    if dtype == "float":
        y = y.withColumn("x", F.transform("x", lambda v: v.cast("float").cast("double")))
    return complete_rows(y, m, {"x": _zeros(k)}) if complete else y


def spmm_layout(layout: DataFrame, x: DataFrame, m: int, k: int, n: int | None = None, **how) -> DataFrame:
    """The same for a padded or compressed row layout; padding adds nothing."""
    return spmm(from_layout(layout), x, m, k, n, **how)


def spmv(coo: DataFrame, v: DataFrame, m: int, n: int | None = None) -> DataFrame:
    """(row, val) = A v for v as (row, val)."""
    size = None if n is None else 8 * n
    joined = _joined(coo, v.select("row", F.col("val").alias("_v")), size, "auto", 8)
    return complete_rows(joined.groupBy("row").agg(F.sum(F.col("val") * F.col("_v")).alias("val")), m, {"val": 0.0})
