"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a cost for the key, -ln(u) / weight with u from an MD5 of key and shard number; the cheapest shard
takes the record. A shard's draw does not depend on the other shards, so a further shard takes records only into
itself, and records move in proportion to the weight added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, checkpoint

#: Rows that are numbered together by one task.
ROWS_PER_BUCKET = 20_000


def costs(key: Column, weights: list[float]) -> Column:
    """array<struct<cost, shard>>: each shard's draw for the key. A null key counts as an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(weight: Column, shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", text, shard.cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / weight).alias("cost"), shard.alias("shard"))

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), draw)


def assign_shards(df: DataFrame, key: str, weights: list[float], shard_col: str = "shard") -> DataFrame:
    """df with `shard_col` int, 0 to len(weights) - 1. Equal keys share a shard; a shard of weight 0 gets nothing.

    An empty table gives an empty table; a column of that name is replaced. No shuffle.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if len(live) < len(weights):
        drawn = F.filter(costs(F.col(key), [w or 1e-300 for w in weights]), lambda x: x["shard"].isin([s for s, _ in live]))
    else:
        drawn = costs(F.col(key), weights)
    return df.withColumn(shard_col, F.array_min(drawn)["shard"])


def number_slots(df: DataFrame, shard_col: str, key: str, order: list[str], n_shards: int, rows_per_bucket: int = ROWS_PER_BUCKET, slot_col: str = "slot") -> DataFrame:
    """df with `slot_col` long: 0, 1, ... without gaps within each shard.

    A shard may hold any number of rows, so it is cut into buckets by a hash of the columns of order and the row's number; counts of
    buckets give each bucket its first slot, and rows are numbered inside their bucket. Even equal rows thus spread over
    buckets, and no bucket passes about rows_per_bucket rows, however uneven the shards are. df is checkpointed, so that row
    numbers stay. Repeated rows get slots of their own; an empty table gives an empty table. A column named slot_col is
    replaced; any other name is kept.
    """
    if slot_col in df.columns:
        df = df.drop(slot_col)
    given = df.columns
    df, _ = aside(df, ["_row", "_bucket", "_first", "_inside", "_rows"])
    names = dict(zip(given, df.columns))
    shard_col, order = names[shard_col], [names[c] for c in order]
    df = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in dict.fromkeys([*order, "_row"])]), F.lit(buckets)).cast("int")
    counts = df.select(shard_col, bucket.alias("_bucket")).groupBy(shard_col, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard_col, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(shard_col, "_bucket").orderBy(*order, "_row")) - 1
    numbered = df.withColumn("_bucket", bucket).withColumn("_inside", inside)
    placed = numbered.join(first, [shard_col, "_bucket"])
    return placed.withColumn(slot_col, F.col("_first") + F.col("_inside")).select(*[F.col(f"`{names[c]}`").alias(c) for c in given], slot_col)
