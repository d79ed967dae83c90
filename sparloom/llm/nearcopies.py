"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of `LEAST` or more.

Rows are numbered; equal texts are joined first, by their SHA-256, and go by the number of one of their rows, so that what is shuffled for
each of a text's keys is short. Each text gets the fingerprint of simhash.py; BK-trees link those that differ in RADIUS bits or
fewer, and the texts of a group that these links reach are candidates. Near copies may lie farther apart than any radius that buckets of
bits can serve (similarity 0.8 makes some 10 of 64 bits differ), so each text's set of shingle hashes also gets BANDS keys of ROWS minimum
hashes each; texts that share a key are candidates too. Two texts of similarity 0.8 share none with a chance of
(1 - 0.8 ** ROWS) ** BANDS, 5e-7; more alike, less. Every pair of candidates is then compared by the exact Jaccard similarity of their
sets, but for pairs that are linked already. Only candidates' sets are shuffled. Buckets with the same members are read once; a bucket over
BUCKET shingles is dealt over blocks, and each two blocks meet in a group of their own, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import aside, binary, checkpoint, map_arrow, written
from .simhash import _LOWER, components

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
ROWS, BANDS = 6, 48
#: Bits in which linked fingerprints differ at most. They are op5's, of three-word shingles: those of five words lie farther apart.
RADIUS = 3
#: Shingles that are hashed by all functions at a time.
COUNTED = 1 << 10
#: Shingles of a bucket that aren't dealt over blocks.
BUCKET = 1 << 22
#: Row numbers that are broadcast at most: 16 MB, and about 40 MB as a hash table.
SMALL = 1 << 20

_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 2**64, (ROWS * BANDS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)
_MIX = _RANDOM.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, a text without words has none."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(p), 42) for p in parts), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, int64."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), COUNTED):
        least = np.minimum(least, ((hashes[i : i + COUNTED] ^ _FLIP) * _TIMES).min(axis=1))
    mixed = (least ^ least >> np.uint64(29)).reshape(BANDS, ROWS) * _MIX
    return (mixed ^ mixed >> np.uint64(32)).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is LEAST or more; sets without members are equal."""
    num, den = LEAST
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def bucket_links(members: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links whose closure is that of all similar pairs of the bucket."""
    groups: list[list[int]] = []
    for i, (key, own) in enumerate(members):
        met, rest = [], []
        for group in groups:
            for place, j in enumerate(group):
                if alike(own, members[j][1]):
                    # The members that others are like stand first, so that most texts are compared but once.
                    group.insert(0, group.pop(place))
                    met.append(group)
                    break
            else:
                rest.append(group)
        for group in met:
            other = members[group[0]][0]
            yield max(key, other), min(key, other)
        groups = [*[[j for group in met for j in group] + [i]], *rest]


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _sketches(batch: pa.RecordBatch) -> dict:
    texts = [t or b"" for t in binary(batch.column("_text")).to_pylist()]
    sets, prints = [shingles(t) for t in texts], [simhash.signed(simhash.fingerprint(t)) for t in texts]
    return {"_n": pa.array([len(s) for s in sets], pa.int64()), "_bands": pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), "_fp": pa.array(prints, pa.int64())}


def _sets(batch: pa.RecordBatch) -> dict:
    return {"_set": pa.array([shingles(t or b"").astype("<u8").tobytes() for t in binary(batch.column("_text")).to_pylist()], pa.binary())}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(members: list) -> pa.RecordBatch:
        pairs = list(bucket_links(members))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    bucket, members = None, []
    for batch in batches:
        for *at, key, own in zip(*[batch.column(c).to_pylist() for c in ("_bucket", "_low", "_high", "_num", "_set")]):
            if at != bucket:
                yield made(members)
                bucket, members = at, []
            members.append((key, np.frombuffer(own, "<u8")))
    yield made(members)


def small(rows: DataFrame) -> DataFrame:
    """rows of a few numbers each, to be broadcast where SMALL at most are there; counted, as estimates may be far off."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def print_groups(sketches: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_num, _n, _fp, _value) of the texts whose fingerprint others have or are linked to; _value: the smallest fingerprint of the group."""
    prints = checkpoint(sketches.groupBy("_fp").agg(F.count(F.lit(1)).alias("_count")))
    roots = components(simhash.link(prints.select(F.col("_fp").alias("fp")), radius))
    groups = prints.join(small(roots.withColumnRenamed("node", "_fp")), "_fp", "left").where("root is not null or _count > 1")
    return sketches.join(small(groups.select("_fp", F.coalesce("root", "_fp").alias("_value"))), "_fp").select("_num", "_n", "_fp", "_value")


def link(texts: DataFrame, sketches: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), b < a, between numbers of distinct texts.

    texts: (_num, _text), with one row at least for each number; sketches: (_num, _n, _bands, _fp), one row for each.
    """
    # Groups of fingerprints are buckets like those of keys, with a number of their own.
    groups = print_groups(sketches).select("_num", "_n", F.lit(BANDS).alias("_band"), "_value")
    rows = groups.unionByName(sketches.select("_num", "_n", F.posexplode("_bands").alias("_band", "_value")))
    hashed = F.xxhash64("_num")
    shared = rows.groupBy("_band", "_value").agg(F.count(F.lit(1)).alias("_count"), F.sum("_n").alias("_size"), F.bit_xor(hashed).alias("_mark"), F.sum(F.shiftright(hashed, 24)).alias("_mark2")).where("_count > 1")
    # Of buckets with the same members one is read.
    once = shared.groupBy("_count", "_size", "_mark", "_mark2").agg(F.min(F.struct("_band", "_value")).alias("x")).select("x.*", "_size")
    members = rows.drop("_n").join(once, ["_band", "_value"]).withColumn("_blocks", F.ceil(F.col("_size") / bucket + F.lit(1e-9)))
    members = checkpoint(members.select("_num", F.xxhash64("_band", "_value").alias("_bucket"), F.col("_blocks").cast("int").alias("_blocks")))
    wanted = members.select("_num").distinct()
    sets = map_arrow(texts.join(small(wanted), "_num"), _sets, [T.StructField("_set", T.BinaryType())], "_text", ["_num"])
    own = F.pmod(F.xxhash64("_num", F.lit(7)), F.col("_blocks")).cast("int")
    dealt = members.select("_num", "_bucket", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("_num", "_bucket", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    met = dealt.join(sets, "_num").repartition("_bucket", "_low", "_high").sortWithinPartitions("_bucket", "_low", "_high", "_num")
    met = met.select("_bucket", "_low", "_high", "_num", "_set")
    return met.mapInArrow(_compare, T.StructType([T.StructField(c, T.LongType()) for c in "ab"])).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each group of texts that links reach: that with the smallest id, or one without an id where no row has any.

    A null text counts as empty; texts without words are one group. Rows that share an id are told apart by their texts; of rows
    with the same id and text one stays. Columns of any name are kept.

    docs is written once with row numbers, and every later step speaks of rows by number. Whole texts are joined with candidates'
    numbers, and with the numbers of the rows to drop; both are broadcast where there are few, and only beyond that are
    texts shuffled.
    """
    docs, back = aside(docs, ["_num", "_key", "_row"])
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    base = written(docs.withColumns({"_row": F.monotonically_increasing_id(), "_key": text_key(text)}))
    slim = base.select(ident.alias("_id"), text.alias("_text"), "_key", "_row")
    rows = checkpoint(map_arrow(slim, _sketches, [T.StructField("_n", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_fp", T.LongType())], "_text", ["_id", "_key", "_row"]))
    # Of equal texts the row that stands for them: the smallest id, null last, and of rows that share it the first. Its number is theirs.
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    distinct = checkpoint(rows.groupBy("_key").agg(first.alias("least"), *[F.first(c).alias(c) for c in ("_n", "_bands", "_fp")]))
    numbered = distinct.select("least", F.col("least.row").alias("_num"), "_n", "_bands", "_fp")
    roots = components(link(slim.select(F.col("_row").alias("_num"), "_text"), numbered.drop("least"), bucket))
    grouped = numbered.select("least", "_num").join(roots.withColumnRenamed("node", "_num"), "_num", "left").withColumn("root", F.coalesce("root", "_num"))
    stand = grouped.groupBy("root").agg(F.min("least").alias("stand")).select(F.col("stand.row").alias("_row"))
    # All rows but those that stand for a group, each by its number.
    dropped = checkpoint(rows.select("_row").join(stand, "_row", "left_anti"))
    return back(base.join(small(dropped), "_row", "left_anti"))
