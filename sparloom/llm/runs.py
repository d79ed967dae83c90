"""Maximal repetitions ("runs") of words, by Lyndon arrays over an ordered alphabet.

Words are compared as they are, by their bytes; nothing but their order is used. For both directions of that order one
sweep from left to right finds, for every word, the longest Lyndon word that begins there: a stack holds the positions
whose next smaller suffix isn't known, and a new position takes off all whose suffix is larger. How far two suffixes
agree is never compared twice: the match that reaches furthest to the right is kept, and a pair that lies inside takes its
answer from the pair that the match copies, or agrees up to the match's end at least (see `_agree`). So the sweep reads each
word once beyond what it copies, which makes it linear. Every run has a Lyndon word of its period's length among those
found in one of the two orders, which is extended to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, map_arrow

#: Words of a run at least.
LEAST = 12
#: Bytes of texts that a task works on together.
BYTES = 2 << 20
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]


def lyndon(s: list) -> tuple[list[int], list[int]]:
    """For each position of s: the next one with a smaller suffix (len(s) if none), and how far both suffixes agree.

    An end of s is smaller than anything. Linear in len(s); only < and == of elements are used.
    """
    n = len(s)
    smaller, agree = [n] * n, [0] * n  # by position: the next smaller suffix
    before, agreed = [-1] * n, [0] * n  # and the one before with a smaller suffix
    box, shift, reach = 0, 0, 0  # s[x] == s[x - shift] for box <= x < reach
    stack: list[int] = []
    for r in range(n):
        here = s[r]
        e = 0
        last = -1  # the position taken off the stack before
        while stack:
            j = stack[-1]
            known = -1
            if last >= 0 and agreed[last] != e:
                if agreed[last] < e:
                    # j and `last` agree for less than `last` and r do: r parts from j where `last` does, and so is larger too.
                    before[r], agreed[r] = j, agreed[last]
                    break
                known = e  # r parts from j where it does from `last`, and so is smaller than both
            elif e == 0 and s[j] != here:
                known = 0
            elif e < reach - r:
                known = _agree(s, j, r, e, box, shift, reach, smaller, agree, before, agreed)
                if known < 0:
                    e = reach - r
            if known >= 0:
                e = known
            else:
                a, b = j + e, r + e
                while b < n and s[a] == s[b]:
                    a += 1
                    b += 1
                e = b - r
                if b > reach:
                    box, shift, reach = r, r - j, b
            if r + e < n and s[j + e] < s[r + e]:
                before[r], agreed[r] = j, e
                break
            smaller[j], agree[j] = r, e
            last = j
            stack.pop()
        stack.append(r)
    return smaller, agree


def _agree(s, j, r, e, box, shift, reach, smaller, agree, before, agreed) -> int:
    """How far the suffixes of j < r agree, e or more, for r inside the kept match; -1: up to the match's end at least.

    With j inside too, the pair (j - shift, r - shift) is the same as far as the match goes. Where that pair was never compared,
    some suffix between j and r agrees with one of them up to the match's end, so either r parts from j where it parted from the
    position taken off before, after e words, or not before the end. With j before the match, r and r - shift agree up to the
    end; if j isn't the smaller one before r - shift, its suffix lies between those of r and r - shift in order, or r has met
    such a one already.
    """
    back = r - shift
    if j >= box:
        source = j - shift
        if smaller[source] == back:
            found = agree[source]
        elif before[back] == source:
            found = agreed[back]
        elif s[j + e] != s[r + e]:
            return e
        else:
            return -1
    elif j != back and before[back] == j:
        found = agreed[back]
    else:
        return -1
    return found if found < reach - r else -1


def runs_of(s: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least two periods and `least` elements, sorted by start and period.

    s: numbers. Of a run's Lyndon words the leftmost counts; it has less than a period of the run before it, so it is
    extended by so much at most, and less than the Lyndon word that ends where it begins.
    """
    n = len(s)
    found = set()
    for values in (s, [-x for x in s]):
        smaller, agree = lyndon(values)
        nxt, fits = np.array(smaller, np.int64), np.array(agree, np.int64)
        period = nxt - np.arange(n)
        # The leftmost one of a run agrees with the next in one element at least, and has less than a period before it.
        for i in np.flatnonzero((fits > 0) & (2 * period + fits > least)).tolist():
            p, e = smaller[i] - i, agree[i]
            most = min(p, i)
            b = 0
            while b < most and s[i - 1 - b] == s[i + p - 1 - b]:
                b += 1
            if b < p and b + e >= p and p + b + e >= least:
                found.add((i - b, p + b + e, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of texts that end at `ends` in data, in order, and the number of words before each text and after the last.

    White space is bytes 9 to 13 and 32; no byte of a longer UTF-8 character is one of them.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    letter = ~space
    first = letter.copy()
    if len(data):
        first[1:] &= space[:-1]
        starts_of_texts = ends[:-1][ends[:-1] < len(data)]
        first[starts_of_texts] = letter[starts_of_texts]  # a text's first byte, whatever ends the text before
    starts = np.flatnonzero(first)
    offsets = np.r_[0, np.cumsum(letter)][np.r_[starts, len(data)]].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[letter]))])
    return words, np.searchsorted(starts, ends, "left")


def _texts(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins, and the last ends; null: empty."""
    column = binary(pc.fill_null(batch.column(text_col), ""))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, ends - (ends[0] if len(ends) else 0)


def _stretches(codes: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of at least `least` words of one text, all of which stand in it more than once. A run lies inside
    one of them, as each of its words does."""
    key = doc * (int(codes.max()) + 1 if len(codes) else 1) + codes
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1], False]
    repeated = np.zeros(len(key) + 2, bool)
    repeated[1:-1][order] = same[:-1] | same[1:]
    edge = repeated[1:] != repeated[:-1]
    edge[1:-1] |= (doc[1:] != doc[:-1]) & repeated[1:-2] & repeated[2:-1]
    at = np.flatnonzero(edge)
    spans = np.stack([at[:-1], at[1:]], axis=1)
    keep = (spans[:, 1] - spans[:, 0] >= least) & repeated[spans[:, 0] + 1] if len(spans) else np.zeros(0, bool)
    return [tuple(x) for x in spans[keep].tolist()]


def find_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST, limit: int = BYTES) -> DataFrame:
    """Columns `keep` (all but those named like a new one when None), `n_words`, `runs` array<struct<start, length, period>> by
    start and period, in words from 0, and `collapsed`: the words left when every run keeps its first period, joined by
    one space.

    Words are `[^\\x20\\x09-\\x0D]+`; a run has its smallest period at least twice and `least` words, and no neighbour goes on with it. A
    null, empty or blank text has no words and no runs, and an empty `collapsed`. Whole texts are read, of any length; equal
    rows give equal rows, and an empty table an empty one. No shuffle; a task holds `limit` bytes of texts or one longer text.
    """

    def add(batch: pa.RecordBatch) -> dict:
        data, ends = _texts(batch, text_col)
        words, counts = _words(data, ends)
        n_docs = batch.num_rows
        doc = np.repeat(np.arange(n_docs), np.diff(counts))
        codes = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
        cover = np.zeros(len(codes) + 1, np.int32)
        for a, b in _stretches(codes, doc, least):
            d, base = int(doc[a]), int(counts[doc[a]])
            for start, length, period in runs_of(codes[a:b].tolist(), least):
                found[d].append((a - base + start, length, period))
                cover[a + start + period] += 1
                cover[a + start + length] -= 1
        kept = np.cumsum(cover[:-1]) == 0
        left = words.filter(pa.array(kept)) if not kept.all() else words
        per_doc = np.add.reduceat(np.r_[kept, 0], counts[:-1]) * (np.diff(counts) > 0) if n_docs else np.zeros(0, np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_doc)], pa.int64()), left)
        text = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
        flat = [r for rs in found for r in rs]
        offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32())
        columns = np.array(flat, np.int64).reshape(len(flat), 3)
        struct = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=[pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
        runs = pa.ListArray.from_arrays(offsets, struct, type=pa.list_(pa.field("element", struct.type, False)))
        return {"n_words": pa.array(np.diff(counts), pa.int64()), "runs": runs, "collapsed": text.cast(pa.large_string()).cast(pa.string())}

    return map_arrow(df, add, FIELDS, text_col, keep, limit)


def words(text: Column) -> Column:
    """The words of a text as an array; none of a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the one that begins first, then that of the smaller period. Null without runs."""
    least = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(least.isNotNull(), F.struct(least["start"].alias("start"), (-least["by"]).alias("length"), least["period"].alias("period")))


def listed(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
