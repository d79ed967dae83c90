"""Row ranges with balanced numbers of entries, and the assignment of rows to them."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.numbers import ceil_div, round_up
from sparloom.operators.prefix import bucket_width, prefix_sum
from sparloom.shared import checkpoint, discard, scratch

#: Rows whose counts one task walks through.
CHUNK_ROWS = 1 << 18
#: Runs of rows whose maps of states one task composes.
GROUP = 64


#: Entries that the rows of one fetch may have between them, but for one boundary's.
FETCH = 1 << 22


class _Counts:
    """Entries of rows 0 to m - 1, written once by ranges of rows; totals of buckets of rows, about the square root of m in number, are held."""

    def __init__(self, nnz: DataFrame, m: int):
        self.spark, self.path = nnz.sparkSession, scratch(nnz.sparkSession)
        self.width = bucket_width(m)
        bucket = F.floor(F.col("row") / self.width).cast("long").alias("bucket")
        nnz.where("nnz > 0").select(bucket, "row", F.col("nnz").cast("long").alias("nnz")).repartitionByRange("row").sortWithinPartitions("row").write.parquet(self.path)
        self.rows = self.spark.read.schema("bucket long, row long, nnz long").parquet(self.path)
        self.starts, self.longest = np.zeros(ceil_div(m, self.width) + 1, np.int64), 0
        for r in self.rows.groupBy("bucket").agg(F.sum("nnz").alias("total"), F.max("nnz").alias("longest")).collect():
            self.starts[r["bucket"] + 1] = r["total"]
            self.longest = max(self.longest, r["longest"])
        self.starts = np.cumsum(self.starts)

    def near(self, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with entries, and the entries before and up to each, of all whose entries reach into one of the spans; one job.

        A span lies between numbers of entries, from the first row on. Only buckets that a span reaches into are read, each in a task of its
        own, and only the spans' rows come to the driver.
        """
        need = []
        for low, high in spans:
            first, last = np.searchsorted(self.starts, low, "left"), np.searchsorted(self.starts, high, "left")
            need += [(b, int(self.starts[b]), low, high) for b in range(max(0, int(first) - 1), min(len(self.starts) - 1, int(last)))]
        wanted = F.broadcast(self.spark.createDataFrame(need, "bucket long, start long, low long, high long"))
        inside = F.sum("nnz").over(Window.partitionBy("bucket").orderBy("row"))
        chosen = self.rows.where(F.col("bucket").isin(sorted({n[0] for n in need})))
        upto = chosen.withColumn("inside", inside).join(wanted, "bucket").withColumn("upto", F.col("start") + F.col("inside"))
        near = upto.where((F.col("upto") >= F.col("low")) & (F.col("upto") - F.col("nnz") < F.col("high"))).select("row", "nnz", "upto").toArrow()
        row, n, end = (near.column(c).to_numpy() for c in ("row", "nnz", "upto"))
        row, first = np.unique(row, return_index=True)
        return row, (end - n)[first], end[first]


def balanced_ranges(nnz: DataFrame, m: int, parts: int) -> DataFrame:
    """(part, start_row, end_row, nnz): whole rows in `parts` consecutive ranges near equal in entries.

    nnz: (row, nnz). Each boundary takes the next quota of entries from the one before it and stops on the nearer side
    of the row that reaches it. So a boundary lies off the sum of the quotas by half of the longest row for each boundary up to it at most,
    and the rows within these bounds are fetched for many boundaries at once: one job however many parts there are, but that a
    job fetches rows with about FETCH entries between them, and bounds start anew from where the last one ended. A row of two
    quotas or more leaves later ranges empty; part_loads shows it.
    """
    parts = max(1, min(parts, m))
    counts = _Counts(nnz, m)
    try:
        bounds, sums = _boundaries(counts, m, parts)
    finally:
        discard(counts.spark, counts.path)
    rows = [(i, bounds[i], bounds[i + 1], sums[i + 1] - sums[i]) for i in range(parts)]
    return nnz.sparkSession.createDataFrame(rows, "part long, start_row long, end_row long, nnz long")


def _boundaries(counts: _Counts, m: int, parts: int) -> tuple[list[int], list[int]]:
    """Rows at which ranges begin, and the last one ends, and the entries before them."""
    nz = int(counts.starts[-1])
    quotas = [(i + 1) * nz // parts - i * nz // parts for i in range(parts + 1)]
    bounds, sums = [0], [0]
    spans: list[tuple[int, int]] = []
    row = before = upto = np.zeros(0, np.int64)
    for i in range(1, parts):
        goal = sums[-1] + quotas[i]
        if bounds[-1] >= m or goal > nz:
            bounds.append(m)
            sums.append(nz)
            continue
        if not quotas[i]:
            bounds.append(bounds[-1])
            sums.append(sums[-1])
            continue
        if not any(low < goal <= high for low, high in spans):
            spans = _spans(sums[-1], quotas[i:parts], counts.longest, nz)
            row, before, upto = counts.near(spans)
        j = int(np.searchsorted(upto, goal, "left"))
        over, under = int(upto[j]) - goal, goal - int(before[j])
        bounds.append(int(row[j]) + (over < under))
        sums.append(int(upto[j] if over < under else before[j]))
    return bounds + [m], sums + [nz]


def _spans(at: int, quotas: list[int], longest: int, nz: int) -> list[tuple[int, int]]:
    """Where the next boundaries' goals lie, (low, high] of entries: as many as FETCH allows for, one at least; overlapping ones joined."""
    spans, taken, off = [], 0, 0
    for q in quotas:
        at += q
        low, high = max(0, at - off - 1), min(nz, at + off)
        taken += high - low
        if spans and taken > FETCH:
            break
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        elif low < high:
            spans.append((low, high))
        off += ceil_div(longest, 2)
    return spans


def default_capacity(nz: int, m: int) -> int:
    """The mean row's entries rounded up to a multiple of 32, 1024 at most."""
    return min(round_up(max(ceil_div(nz, max(m, 1)), 1), 32), 1024)


def _walk(each: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a run of rows' counts: running sums; for each row as the first of a block where that block ends (beyond the
    run: -1); and for each row as a first, and the run's end, the state at the run's end (-1: a block just ended, else the open
    one's entries)."""
    n = len(each)
    sums = np.r_[0, np.cumsum(each)]
    # With `capacity` a positive number, the block from p reaches it at the first i > p.
    reach = np.searchsorted(sums, sums[:-1] + capacity, "left")
    over = (reach <= n) & (sums[np.minimum(reach, n)] - sums[:-1] > capacity) & (reach - np.arange(n) > 1)
    ends = np.where(reach > n, -1, reach - over)
    # The last block that begins in the run, by doubling the blocks that are passed over.
    last = np.r_[np.where(ends < 0, np.arange(n), ends), n]
    while not np.array_equal(further := last[last], last):
        last = further
    return sums, ends, np.where(last == n, -1, sums[-1] - sums[last])


def _enter(sums: np.ndarray, entry: int, capacity: int) -> int:
    """First row of the next block for a block open with `entry` entries before the run; -1 where it goes on."""
    if entry < 0:
        return 0
    i = int(np.searchsorted(sums[1:], capacity - entry, "left")) + 1
    if i >= len(sums):
        return -1
    return i - 1 if entry + sums[i] > capacity else i


#: The state at a run's end of a block that goes on through all of it.
OPEN = -2


#: A run's map of states: the state after a block that just ended, the run's entries, and for blocks with c entries before the run, by the
#: least c of each interval, the state after it; OPEN: c and the run's entries.
Map = tuple[int, int, np.ndarray, np.ndarray]


def _exits(sums: np.ndarray, state: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of a block's entries before the run, by their least ones from 0 up, and the state at the run's end of each.

    An open block of `capacity - sums[i]` entries ends after row i - 1 exactly; one with more, up to what ends it sooner, would
    pass the capacity there and ends before that row.
    """
    full = capacity - sums[1:]
    rows = np.arange(1, len(sums))
    least = np.r_[0, np.stack([full, full + 1], axis=1)[::-1].ravel()]
    at = np.r_[-1, np.stack([rows, rows - 1], axis=1)[::-1].ravel()]
    # Of equal bounds the last one holds; bounds below 0 or from the capacity on hold for no block.
    keep = np.r_[least[1:] > least[:-1], True] & (least < capacity)
    first = max(0, int(np.searchsorted(least, 0, "right")) - 1)
    keep[:first] = False
    least, at = np.maximum(least[keep], 0), at[keep]
    return _merged(least, np.where(at < 0, OPEN, state[at]))


def _merged(least: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, states[1:] != states[:-1]] if len(states) else np.zeros(0, bool)
    return least[new], states[new]


def _after(states: np.ndarray, of: Map) -> np.ndarray:
    """States at the end of a run by those at its start."""
    closed, total, least, found = of
    at = np.maximum(np.searchsorted(least, states, "right") - 1, 0)
    passed = np.where(found[at] == OPEN, states + total, found[at])
    return np.where(states < 0, closed, passed)


def _compose(one: Map, two: Map) -> Map:
    """The map of two runs, one after the other. It has as many intervals as both at most, and no more than the capacity."""
    closed, total, least, states = one
    # Where the first run leaves a block open, the second one's bounds, less what the first adds, cut its interval.
    ends = np.r_[least[1:], np.iinfo(np.int64).max]
    still = states == OPEN
    cuts = [two[2][(two[2] > lo + total) & (two[2] < hi)] - total for lo, hi in zip(least[still], np.where(ends[still] > np.iinfo(np.int64).max - total, ends[still], ends[still] + total))]
    bounds = np.unique(np.concatenate([least, *cuts]))
    before = states[np.searchsorted(least, bounds, "right") - 1]
    entered = np.where(before == OPEN, bounds + total, before)
    after = _after(entered, two)
    stays = (before == OPEN) & (two[3][np.maximum(np.searchsorted(two[2], entered, "right") - 1, 0)] == OPEN)
    return int(_after(np.array([closed]), two)[0]), total + two[1], *_merged(bounds, np.where(stays, OPEN, after))


_MAPS = "at long, closed long, total long, least array<long>, states array<long>"


def _rows_of(maps: pd.DataFrame) -> list[Map]:
    return [(int(r.closed), int(r.total), np.asarray(r.least, np.int64), np.asarray(r.states, np.int64)) for r in maps.itertuples()]


def _states(maps: DataFrame, runs: int) -> DataFrame:
    """(at, state): the state in which each run is entered, from the runs' maps: an associative scan.

    GROUP runs' maps are composed into one, theirs again, until one group is left; on the way back each group's first state goes
    through its runs. So no task and not the driver sees more than GROUP runs, and there are log(runs) steps.
    """
    spark = maps.sparkSession
    group = F.expr(f"at div {GROUP}")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _rows_of(pdf.sort_values("at"))
        closed, total, least, states = functools.reduce(_compose, found)
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0]) // GROUP], "closed": [closed], "total": [total], "least": [least], "states": [states]})

    def walk(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        states = [int(entered["state"].iloc[0])]
        for m in _rows_of(pdf)[:-1]:
            states.append(int(_after(np.array([states[-1]]), m)[0]))
        return pd.DataFrame({"at": pdf["at"], "state": states})

    levels = [maps]
    while runs > GROUP:
        levels.append(checkpoint(levels[-1].groupBy(group).applyInPandas(join, _MAPS)))
        runs = ceil_div(runs, GROUP)
    found = spark.range(1).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("state"))
    for level in reversed(levels):
        found = level.groupBy(group.alias("_g")).cogroup(found.groupBy(F.col("at").alias("_g"))).applyInPandas(walk, "at long, state long")
    return found


def capacity_blocks(nnz: DataFrame, m: int, capacity: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(block, start_row, end_row): consecutive rows packed greedily up to `capacity` entries; an oversize row is a block
    of its own, and the last row goes into the last block whatever it has.

    nnz: (row, nnz) of all rows 0 to m - 1. A boundary depends on the one before it, and all that a run of rows needs from
    its left is whether a block is open and with how many entries. The counts are written once, by runs. The first pass gives each
    run's map from the state at its start to that at its end, by intervals, two for each of its rows at most whatever the capacity;
    maps are composed by groups (see _states), and the second pass gives each run's boundaries. The driver sees neither.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = nnz.sparkSession
    runs = ceil_div(max(m - 1, 0), chunk_rows)
    counted = nnz.where(F.col("row") < m - 1).select(F.floor(F.col("row") / chunk_rows).cast("long").alias("chunk"), "row", F.col("nnz").cast("long").alias("nnz"))
    counted = checkpoint(counted.repartition(max(1, min(runs, int(spark.conf.get("spark.sql.shuffle.partitions")))), "chunk"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, _, state = _walk(pdf.sort_values("row")["nnz"].to_numpy(), capacity)
        least, states = _exits(sums, state, capacity)
        return pd.DataFrame({"at": [pdf["chunk"].iloc[0]], "closed": [int(state[0])], "total": [int(sums[-1])], "least": [least], "states": [states]})

    def bounds(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"start_row": []}, dtype="int64")
        pdf = pdf.sort_values("row")
        first, came = int(pdf["row"].iloc[0]), int(entered["state"].iloc[0])
        sums, ends, _ = _walk(pdf["nnz"].to_numpy(), capacity)
        out, ends = [], ends.tolist()
        p = _enter(sums, came, capacity)
        if came >= 0 and p >= 0:
            out.append(first + p)
        while 0 <= p < len(ends):
            p = ends[p]
            if p >= 0:
                out.append(first + p)
        return pd.DataFrame({"start_row": out}, dtype="int64")

    if runs > 1:
        states = _states(checkpoint(counted.groupBy("chunk").applyInPandas(exits, _MAPS)), runs)
    else:
        states = spark.range(1).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("state"))
    found = counted.groupBy("chunk").cogroup(states.groupBy(F.col("at").alias("chunk"))).applyInPandas(bounds, "start_row long")
    return consecutive(found.union(spark.range(min(m, 1))).distinct(), m)


def consecutive(starts: DataFrame, m: int) -> DataFrame:
    """(block, start_row, end_row) of the ranges that begin at these rows; ranges are numbered and closed by running sums
    over buckets of rows."""
    width = bucket_width(m)
    numbered = prefix_sum(starts.where(F.col("start_row") < m).withColumn("_one", F.lit(1).cast("long")), "start_row", "_one", "block", width)
    bucket = F.floor(F.col("start_row") / width).cast("long")
    firsts = numbered.groupBy(bucket.alias("_b")).agg(F.min("start_row").alias("_first"))
    later = firsts.select("_b", F.coalesce(F.lead("_first").over(Window.orderBy("_b")), F.lit(m)).alias("_after"))
    inside = F.lead("start_row").over(Window.partitionBy("_b").orderBy("start_row"))
    return numbered.withColumn("_b", bucket).withColumn("_next", inside).join(later, "_b").select("block", "start_row", F.coalesce("_next", "_after").cast("long").alias("end_row"))


def assign_parts(df: DataFrame, ranges: DataFrame, m: int, part_col: str = "part") -> DataFrame:
    """df with the `part_col` of the range that holds its row.

    Ranges are cut at multiples of a width, about one range wide, and joined by the number of the cut: an equi-join with
    start <= row < end as the rest, so many ranges cost no more than few. Small ranges are broadcast by Spark itself.
    """
    full = ranges.where("start_row < end_row").select(F.col(part_col).alias("_part"), "start_row", "end_row")
    width = max(1, m // max(1, full.count()))
    cuts = full.withColumn("_cut", F.explode(F.sequence(F.floor(F.col("start_row") / width), F.floor((F.col("end_row") - 1) / width))))
    placed = df.withColumn("_cut", F.floor(F.col("row") / width))
    found = placed.join(cuts, (placed["_cut"] == cuts["_cut"]) & (F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("end_row")))
    return found.select(*[df[c] for c in df.columns], F.col("_part").alias(part_col))


def part_loads(nnz: DataFrame, ranges: DataFrame, m: int) -> DataFrame:
    """(part, load, imbalance): entries of each range, empty ones included, and the largest load by the mean."""
    loads = assign_parts(nnz, ranges, m).groupBy("part").agg(F.sum("nnz").alias("load"))
    every = ranges.select("part").join(loads, "part", "left").select("part", F.coalesce("load", F.lit(0)).alias("load"))
    worst = every.agg(F.max("load").alias("_most"), F.avg("load").alias("_mean"))
    return every.crossJoin(worst).select("part", "load", F.when(F.col("_mean") > 0, F.col("_most") / F.col("_mean")).otherwise(F.lit(1.0)).alias("imbalance"))
