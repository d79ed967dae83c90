"""SimHash near-duplicates, linked by BK-trees.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints that differ in `radius` bits or fewer are
linked, and a document's group is what links reach.

Equal fingerprints are joined first, so copies cost one row. Two fingerprints within the radius agree on one of radius + 1
blocks of bits at least: each distinct fingerprint goes to the bucket of each of its blocks, and each bucket is a
shard with a BK-tree of its own, built where the bucket's rows meet. (Sending all trees to all tasks would broadcast
data that grows with the corpus.) A bucket over the tree's bound is cut again by its free bits into radius + 1 blocks, which
is exact; each cut leaves two thirds of the free bits, so the number of distinct fingerprints in a bucket falls under any
bound. A tree's children hang on their integer Hamming distance to the parent, and a search follows only the edges
that the triangle inequality leaves within the radius. A bucket gives one link for each member that it connects, never its
pairs. Groups come from alternating large-star and small-star steps over these links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, binary, checkpoint, map_arrow

BITS = 64
RADIUS = 2
SHINGLE = 3
#: Added to a signed fingerprint: the numbers are then non-negative, in the same order and with the same distances.
OFFSET = 1 << (BITS - 1)
#: Distinct fingerprints in one BK-tree.
TREE_ROWS = 2048
#: A fingerprint with more rows than this, and than a HOT-th of all, is hot.
HOT_ROWS, HOT = 256, 1_000
#: Tasks that share a hub's links.
PARTS = 64
#: Links up to which TASKS tasks do a round's work, with nodes' smallest neighbours broadcast: two numbers a node, some 25 MB on the driver at most.
FEW, TASKS = 1 << 17, 8
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 14

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 where over half of the shingles' hashes have it; 0 for a text without words."""
    import numpy as np
    import xxhash

    # bytes.split() splits at the bytes 0x09 to 0x0D and 0x20.
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    parts = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(p), 42) for p in parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), COUNTED):
        block = hashes[i : i + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


class BKTree:
    """Burkhard-Keller tree of integers under Hamming distance; a child's edge is its distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge in range(max(1, d - radius), d + radius + 1):
                child = children.get(edge)
                if child:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node, children = self.root
        while (d := (node ^ value).bit_count()) and (child := children.get(d)):
            node, children = child
        if d:
            children[d] = (value, {})


def bucket_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(value, smallest value of its component in the bucket) for the values that aren't the smallest themselves."""
    parent = {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    tree = BKTree()
    for v in parent:
        for other in tree.within(v, radius):
            a, b = root(v), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    for v in values:
        if (r := root(v)) != v:
            yield v, r


def signed(v: int) -> int:
    return v - (1 << BITS) if v >> (BITS - 1) else v


def cut(mask: int, radius: int) -> list[int]:
    """The masks that the bits free in `mask` give, cut into radius + 1 blocks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    n = radius + 1
    return [mask | sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]


def into_buckets(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Rows (fp, mask) to (fp, mask, value) for each mask cut from theirs."""
    cuts = F.create_map(*[x for m, found in masks.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in found]))])
    return rows.select("fp", F.explode(F.element_at(cuts, F.col("mask"))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def link(fingerprints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b), b < a, between distinct fingerprints `fp` long; their closure is that of all pairs within the radius."""
    level, masks, ready = fingerprints.withColumn("mask", F.lit(0).cast("long")), [0], None
    while True:
        cuts = {m: cut(m, radius) for m in masks}
        rows = into_buckets(level, cuts)
        counts = rows.groupBy("mask", "value").count().where("count > 1")
        rows = rows.join(counts, ["mask", "value"])
        masks = [c for found in cuts.values() for c in found]
        part = rows.where(F.col("count") <= tree_rows)
        full = [m for m in masks if BITS - m.bit_count() > tree_rows.bit_length() - 1]
        if full and counts.where(F.col("count") > tree_rows).isEmpty():
            full = []
        if not full:  # in the last cut no bucket can pass the bound
            part = rows
        ready = part if ready is None else ready.unionByName(part)
        if not full:
            break
        level = checkpoint(rows.where(F.col("count") > tree_rows).select("fp", "mask"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, values = None, []
        for batch in batches:
            made: list[tuple[int, int]] = []
            for mask, value, fp in zip(*[batch.column(c).to_pylist() for c in ("mask", "value", "fp")]):
                if (mask, value) != bucket:
                    made += bucket_links(values, radius)
                    bucket, values = (mask, value), []
                values.append(fp + OFFSET)
            yield _pairs(made)
        yield _pairs(list(bucket_links(values, radius)))

    rows = ready.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return rows.mapInArrow(trees, T.StructType([T.StructField(c, T.LongType()) for c in "ab"])).distinct()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] - OFFSET for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node that it reaches.

    Every round links each node's neighbours to its smallest one. A node may have any share of the links: those of a hub are dealt over
    PARTS tasks, each of which gets the hub's smallest neighbour. Fewer than HOT nodes can be hubs. No round makes links more; where they are
    FEW or fewer, they stay where they are and the smallest neighbours come to them, and a round's stages have TASKS tasks each, however
    many partitions shuffles have: the driver keeps an account of each task, and there are some ten stages a round.
    """
    links, state = checkpoint(links), None
    count = links.count()
    most, few = max(HOT_ROWS, count // HOT), count <= FEW

    def dealt_to_tasks(rows: DataFrame) -> DataFrame:
        return rows.coalesce(TASKS) if few else rows

    def to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
        """edges (a, b) with `m`, that of a in least (a, m, n)."""
        if few:
            return edges.join(F.broadcast(least.select("a", "m")), "a")
        hubs = F.broadcast(least.where(F.col("n") > most).select("a", F.lit(True).alias("hub")))
        salt = F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
        dealt = edges.join(hubs, "a", "left").withColumn("part", salt).drop("hub")
        copies = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, PARTS - 1).otherwise(0)))
        return dealt.join(least.select("a", "m", copies.alias("part")), ["a", "part"]).drop("part")

    links = dealt_to_tasks(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = dealt_to_tasks(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = dealt_to_tasks(to_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = dealt_to_tasks(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = to_least(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpoint(dealt_to_tasks(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()))
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_fingerprints(docs: DataFrame, text_col: str, shingle: int, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs with `fp` long, the fingerprint as a signed number."""

    def add(batch: pa.RecordBatch) -> dict:
        return {"fp": pa.array([signed(fingerprint(t or b"", shingle)) for t in binary(batch.column(text_col)).to_pylist()], pa.int64())}

    return map_arrow(docs, add, [T.StructField("fp", T.LongType())], text_col, keep)


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row per document: id_col, fingerprint string (16 hex digits), component_id (the smallest id of its group).

    A null or empty text has fingerprint zero and is linked like any other; repeated rows stay rows of one group; other
    columns are left out. Only ids and fingerprints are shuffled.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    prints = checkpoint(with_fingerprints(slim, "_text", shingle, ["_id"]))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(link(distinct.select("fp"), radius, tree_rows))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(smallest, "root").select("fp", "component")
    group = checkpoint(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "copies"))
    # Fewer than HOT fingerprints can have over a HOT-th of all rows each: these are broadcast, so that no task of the
    # join gets all copies of a text.
    most = max(HOT_ROWS, prints.count() // HOT)
    hot = F.broadcast(group.where(F.col("copies") > most).select("fp", "component_id"))
    cold = group.where(F.col("copies") <= most).select("fp", "component_id")
    told = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    return told.select(F.col("_id").alias(id_col), hexed().alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **how) -> DataFrame:
    """docs with one row of each group: the one with the smallest id, or any one of them where rows share that id.

    Documents without an id can't be told apart and stay. Ids to drop are joined to the documents, by a broadcast only where
    Spark finds them small.
    """
    groups = checkpoint(near_duplicates(docs, id_col, text_col, shingle, **how))
    docs, back = aside(docs, ["fp", "_print"])
    repeated = groups.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    dropped = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    if repeated.isEmpty():
        return back(docs.join(dropped, id_col, "left_anti"))
    once = docs.join(dropped.union(repeated), id_col, "left_anti").select(docs.columns)
    # Rows that share an id may differ in text: fingerprints tell which of them stand for a group.
    stand = groups.where(F.col(id_col) == F.col("component_id")).select(id_col, F.col("fingerprint").alias("_print")).distinct()
    more = with_fingerprints(docs.join(repeated, id_col, "left_semi"), text_col, shingle, docs.columns).withColumn("_print", hexed())
    more = more.join(stand, [id_col, "_print"], "left_semi").dropDuplicates([id_col]).select(docs.columns)
    return back(once.unionByName(more))
