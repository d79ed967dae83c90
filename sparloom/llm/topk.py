"""Exact top-k search by inner product of whole-number vectors: distributed histogram selection.

Queries come in blocks of bounded size. For a block, every task scores all its vectors against all the block's queries and
counts the scores by bins; the counts are added up over all tasks, the bin that holds a query's k-th score becomes its new range,
and another round counts inside it, until the range is one score or passes as a whole. Ties of a k-th score that don't all
pass are then cut by id in the same way. A last round keeps the scores that pass: k for each query, however many tasks there are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder

#: Queries that are scored together. Their vectors are broadcast, and a task holds BINS counts for each.
BLOCK = 4096
#: Bins of a round.
BINS = 1024
#: Scores that a task holds at a time.
CELLS = 1 << 21
#: Vectors of a task.
ROWS = 20_000
#: Rows of a task's first run; runs double up to CELLS, so that the first ones already tell what later ones needn't count.
FIRST = 64
#: Whole sums below these are exact in single and in double precision.
EXACT_SINGLE, EXACT = 1 << 24, 1 << 53
#: Scores beyond this raise.
MOST = 1 << 61
LONG = 1 << 63


def whole_numbers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null, a NaN or an infinity. A component
    that no long holds raises."""
    x = F.transform(vector, lambda e: e.cast("double") * scale)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fits = ~F.exists(x, lambda e: F.abs(e) >= float(MOST))
    return F.when(vector.isNotNull() & ~bad, F.when(fits, F.transform(x, lambda e: F.floor(e))).otherwise(F.raise_error(F.lit("a component is too large")).cast("array<bigint>")))


class _Block:
    """A block's queries and how far each one's search has come.

    A score counts by its distance from the highest possible one. Distances below `low` pass; `low` to `high` holds `need` more
    that pass, all of it where `whole`. Of a distance `low` == `high` that doesn't pass as a whole, ids pass in the same way by
    `first`, `last`, `ids_need` and `ids_whole`.
    """

    def __init__(self, rows: list[int], ids: list[int], vectors: np.ndarray, top: list[int], k: int, first: int, last: int):
        n = len(rows)
        self.rows, self.ids, self.vectors, self.top = np.array(rows, np.int64), ids, vectors, np.array(top, np.int64)
        self.low, self.high = np.zeros(n, np.uint64), 2 * np.array(top, np.uint64)
        self.need, self.whole = np.full(n, k, np.int64), np.zeros(n, bool)
        self.first, self.last = np.full(n, first, np.uint64), np.full(n, last, np.uint64)
        self.ids_need, self.ids_whole = np.zeros(n, np.int64), np.zeros(n, bool)

    def scored(self, batches: Iterator[pa.RecordBatch], kind: type, asked: np.ndarray, reach: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows: (rows, their ids as sort keys, then query, row and distance of each score that counts, by query and row).

        What counts is a score of a query that is `asked`, of another row than its own, at a distance of `reach` at most, by query; reach
        may shrink between runs.
        """
        only = np.flatnonzero(asked)
        queries, top = self.vectors[only].astype(kind), self.top[only]
        most = max(1, CELLS // max(1, len(only)))
        size = min(FIRST, most)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at, size = at + part.num_rows, min(2 * size, most)
                scores = queries @ _matrix(part.column("_v"), queries.shape[1], kind).T
                least = (top - reach[only].view(np.int64)).astype(kind)
                if kind is not np.int64:
                    least = np.nextafter(least, kind(-np.inf))  # it may have been rounded up; what lies below is dropped next
                q, row = np.nonzero(scores >= least[:, None])
                distance = (top[q] - scores[q, row].astype(np.int64)).view(np.uint64)
                q = only[q]
                counts = (distance <= reach[q]) & (part.column("_row").to_numpy()[row] != self.rows[q])
                yield part, _key(part.column("_id")), q[counts], row[counts], distance[counts]


def _key(ids: pa.Array) -> np.ndarray:
    """Ids as unsigned numbers in their order; a null one counts as the largest long."""
    return ids.fill_null(LONG - 1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(LONG)


def _matrix(vectors: pa.Array, dim: int, kind: type) -> np.ndarray:
    """A vector a row; shorter ones end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _refine(rows: DataFrame, b: _Block, kind: type, bins: int, by_id: bool) -> bool:
    """One round over distances, or over the ids of ties. False where nothing is left to refine."""
    low, high, need, whole = (b.first, b.last, b.ids_need, b.ids_whole) if by_id else (b.low, b.high, b.need, b.whole)
    live = ~whole & (low < high)
    if by_id:
        live &= ~b.whole
    if not live.any():
        return False
    width = np.array([-(-(int(h) - int(l) + 1) // bins) for l, h in zip(low, high)], np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast((b, live, low, high, need, width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, live, low, high, need, width = shared.value
        counts = np.zeros((len(live), bins), np.int64)
        last, seen, due = high.copy(), 0, 0  # what lies beyond the bin with this task's own k-th so far is never asked for
        for part, ids, q, at, distances in b.scored(batches, kind, live, b.low if by_id else last):
            value = ids[at] if by_id else distances
            inside = (value >= low[q]) & (value <= last[q])
            if by_id:
                inside &= distances == b.low[q]
            q, value = q[inside], value[inside]
            np.add.at(counts.reshape(-1), q * bins + ((value - low[q]) // width[q]).astype(np.int64), 1)
            seen += part.num_rows
            if seen >= due:  # each time that rows have doubled
                due = 2 * seen
                reached = np.cumsum(counts, axis=1) >= need[:, None]
                within = (reached.argmax(axis=1).astype(np.uint64) + np.uint64(1)) * width - np.uint64(1)
                last[:] = np.where(reached[:, -1], low + np.minimum(within, high - low), high)
        # A query's k-th of all comes no later than its k-th of this task, so later bins are never asked for.
        before = np.cumsum(counts, axis=1) - counts
        q, at = np.nonzero((counts > 0) & (before < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[q, at])], names=["q", "bin", "n"])

    total = rows.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    needs = rows.sparkSession.createDataFrame(list(enumerate(need.tolist())), "q int, need long")
    upto = F.sum("n").over(Window.partitionBy("q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    summed = total.withColumn("upto", upto).join(F.broadcast(needs), "q")
    # One row for each query of the block.
    hits = summed.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("q", "bin", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("left")).collect()
    shared.destroy()
    found = {h["q"]: h for h in hits}
    for q in np.flatnonzero(live).tolist():
        if q not in found:
            whole[q] = True  # there are fewer than are needed, and all pass
            continue
        at = int(low[q]) + found[q]["bin"] * int(width[q])
        low[q], high[q] = at, min(int(high[q]), at + int(width[q]) - 1)
        need[q] = found[q]["left"]
        whole[q] = found[q]["left"] == found[q]["n"]
    return True


def _passing(rows: DataFrame, b: _Block, kind: type) -> DataFrame:
    """(_q, query_id, vec_id, score) of what passes."""
    shared = rows.sparkSession.sparkContext.broadcast(b)
    schema = pa.schema([("_q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        ids_of = pa.array(b.ids, pa.int64())
        given = np.zeros(len(b.ids), np.int64)
        for part, ids, q, at, far in b.scored(batches, kind, np.ones(len(b.ids), bool), b.high):
            key = ids[at]
            keep = (far < b.low[q]) | b.whole[q]
            tie = ~keep & (far == b.low[q])
            keep |= tie & ((key < b.first[q]) | b.ids_whole[q] & (key <= b.last[q]))
            # Rows of the last id that is needed in part are all the same, score and id; a task gives as many as are needed at most.
            same = np.flatnonzero(tie & ~b.ids_whole[q] & (key == b.first[q]))
            place = np.arange(len(same)) - np.searchsorted(q[same], q[same], "left")
            keep[same[given[q[same]] + place < b.ids_need[q[same]]]] = True
            given += np.bincount(q[same], minlength=len(given))
            q, at = q[keep], at[keep]
            score = b.top[q] - far[keep].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b.rows[q]), ids_of.take(pa.array(q)), part.column("_id").take(pa.array(at)), pa.array(score)], schema=schema)

    return rows.mapInArrow(emit, "_q long, query_id long, vec_id long, score long")


def _search(rows: DataFrame, b: _Block, kind: type, bins: int) -> DataFrame:
    while _refine(rows, b, kind, bins, False):
        pass
    b.ids_need = np.where(b.whole, 0, b.need)
    while _refine(rows, b, kind, bins, True):
        pass
    return _passing(rows, b, kind)


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): for every row where is_query holds the k highest scores of all other
    rows, all if there are fewer; ties go to smaller ids, null ones last.

    A score is the inner product of floor(scale * x) of both vectors, in whole numbers; one beyond 2**61 raises. Vectors that are
    null or hold a null, NaN or infinity take no part; a shorter vector counts as if it ended in zeros. A row is itself, whatever
    its id: repeated rows find each other, and each repeated query has its own result. An empty table, or one without queries,
    gives an empty table; other columns play no part, whatever their names.

    The vectors are written once; each round scores all of them for a block of `block` queries. What is shuffled is the counts of
    bins that may hold a k-th score, k for each query and task at most.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS))
    asked = F.coalesce(is_query, F.lit(False)).alias("_asked")
    found = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("_v"), asked).where("_v is not null")
    rows = checkpoint(found.repartition(tasks).withColumn("_row", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    largest = F.array_max(F.transform("_v", lambda x: F.abs(x)))
    s = rows.agg(F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("dim"), F.coalesce(F.max(norm), F.lit(0.0)).alias("norm"), F.coalesce(F.max(largest), F.lit(0)).alias("x"), F.min("_id").alias("a"), F.max("_id").alias("z"), F.count("_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    if s["norm"] ** 2 >= MOST:
        raise OverflowError("scores may be beyond 2**61")
    sums = s["dim"] * s["x"] ** 2
    kind = np.float32 if sums < EXACT_SINGLE else np.float64 if sums < EXACT else np.int64
    first, last = (s["a"] or 0) + LONG, LONG + (LONG - 1 if s["n"] < s["all"] else s["z"] or 0)
    path = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], "_q long, query_id long, vec_id long, score long")
    empty.write.parquet(path)

    def flush(held: list) -> None:
        vectors = _matrix(pa.array([r["_v"] for r in held], pa.list_(pa.int64())), max(1, s["dim"]), np.int64)
        top = [int(math.sqrt(sum(x * x for x in r["_v"])) * s["norm"] * (1 + 1e-9)) + 1 for r in held]
        b = _Block([r["_row"] for r in held], [r["_id"] for r in held], vectors, top, k, first, last)
        _search(rows.select("_id", "_v", "_row"), b, kind, bins).write.mode("append").parquet(path)

    held: list = []
    for r in rows.where("_asked").select("_row", "_id", "_v").toLocalIterator():  # in the order of _row
        held.append(r)
        if len(held) == block:
            flush(held)
            held = []
    if held:
        flush(held)
    got = spark.read.schema(empty.schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
