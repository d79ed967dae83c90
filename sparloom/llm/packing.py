"""Best-fit packing into bins of several permitted sizes.

A document's tokens, here its UTF-8 bytes and an end mark, are cut into pieces of the largest size at most. Pieces are
dealt over shards of bounded size by a hash of id, place and row, so that rows of one id spread too, and each shard is packed on its own: longest piece first, into the open bin
with the least room that suffices; where none does, a bin opens whose size costs least for each token that it can still
be given. A shard is packed once for each size as the largest to open, the cheapest packing stays, and at last each
bin shrinks to the smallest size that holds its contents. What shards lose against one packing of all is one
partly filled bin each.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

#: Permitted sequence lengths in tokens.
SIZES = (1024, 2048, 4096, 8192)
#: What a sequence costs beside its tokens, in tokens.
OVERHEAD = 64
ROWS_PER_SHARD = 20_000


def costs(sizes: tuple[int, ...], overhead: int = OVERHEAD) -> dict[int, int]:
    return {s: s + overhead for s in sizes}


def best_fit(lengths: list[int], cost: dict[int, int], most: int) -> tuple[list[int], list[int]]:
    """Bin of each length (given longest first), and each bin's used tokens; new bins have size `most` or less, or
    the smallest that holds the piece."""
    sizes = sorted(cost)
    rest = sum(lengths)
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r: an open bin has room r
    bins, used = [], []
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            least = next(s for s in sizes if s >= n)
            room = min((s for s in sizes if least <= s <= max(most, least)), key=lambda s: (cost[s] / min(s, rest), s))
            b = len(used)
            used.append(0)
        used[b] += n
        rest -= n
        if room > n:
            open_bins.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
        bins.append(b)
    return bins, used


def shrink(used: list[int], sizes: tuple[int, ...]) -> list[int]:
    order = sorted(sizes)
    return [next(s for s in order if s >= u) for u in used]


def pack(lengths: list[int], cost: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Bin of each length (longest first), used tokens and final size of each bin, by the cheapest of the packings."""
    found = None
    for most in sorted(cost, reverse=True):
        bins, used = best_fit(lengths, cost, most)
        final = shrink(used, tuple(cost))
        total = sum(cost[s] for s in final)
        if found is None or total < found[0]:
            found = (total, bins, used, final)
    return found[1:] if found else ([], [], [])


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes and an end mark; a null text has the mark alone."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, rows_per_shard: int = ROWS_PER_SHARD, n_tokens: Column | None = None) -> DataFrame:
    """One row per piece: id_col, piece int, start and length (tokens of the document), bin_id long, bin_size int (one
    of sizes), bin_used int, bin_start int (where the piece begins in its bin).

    n_tokens: token count of a document, byte_tokens of the text when None. Every token of every document is in one
    bin; a document without text has its end mark. Repeated rows are packed one by one, equal lengths in order of id
    and piece; any number of them, and of rows without an id, spreads over the shards. An empty table gives no rows. Only ids
    and lengths are shuffled.
    """
    cost, largest = costs(sizes, overhead), max(sizes)
    tokens = byte_tokens(F.col(f"`{text_col}`")) if n_tokens is None else n_tokens
    slim = checkpoint(docs.select(F.col(f"`{id_col}`").alias(id_col), tokens.alias("_tokens")))
    total = slim.agg(F.sum(F.ceil(F.col("_tokens") / largest))).first()[0] or 0
    shards = max(1, math.ceil(total / rows_per_shard))
    # Rows keep their numbers, as the checkpoint keeps their places.
    pieces = slim.withColumn("_row", F.monotonically_increasing_id()).where("_tokens > 0").select(id_col, "_tokens", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tokens") - 1, F.lit(largest).cast("long"))).alias("start"))
    pieces = pieces.select(
        id_col,
        (F.col("start") / largest).cast("int").alias("piece"),
        "start",
        F.least(F.col("_tokens") - F.col("start"), F.lit(largest)).cast("int").alias("length"),
        F.pmod(F.xxhash64(F.col(id_col), "start", "_row"), F.lit(shards)).cast("int").alias("_shard"),
    )
    schema = T.StructType([*[pieces.schema[c] for c in (id_col, "piece", "start", "length")], T.StructField("bin_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("bin_size", "bin_used", "bin_start")]])

    def one_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        bins, used, final = pack(lengths, cost)
        filled, starts = [0] * len(used), []
        for b, n in zip(bins, lengths):
            starts.append(filled[b])
            filled[b] += n
        first = table["_shard"][0].as_py() << 32
        made = [pa.array([first + b for b in bins], pa.int64()), pa.array([final[b] for b in bins], pa.int32()), pa.array([used[b] for b in bins], pa.int32()), pa.array(starts, pa.int32())]
        return pa.Table.from_arrays([*[table[c] for c in (id_col, "piece", "start", "length")], *made], names=schema.names)

    return pieces.groupBy("_shard").applyInArrow(one_shard, schema)
