"""Top-k search against a sort of all scores, with bins and blocks so small that every kind of round runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, _row int, rank string, score string"


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0], x[1], x[3], x[2] is None, x[2] or 0))


def searched(spark, rows, k, **how):
    df = spark.createDataFrame([(i, v, 1, "own", "own") for i, v in rows], SCHEMA)
    return in_order((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, k, **how).collect())


def sorted_all(rows, k):
    whole = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, i, v in whole:
        if i is None or i % 2:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, j) for m, j, w in whole if m != n)
        want += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scores[:k])]
    return in_order(want)


@pytest.mark.parametrize("bins,block", [(60, 12), (1024, 4096)])
def test_against_a_sort(spark, bins, block):
    rng = random.Random(bins)
    rows = [(rng.choice([rng.randrange(40), -rng.randrange(9), 2**63 - 2 - rng.randrange(3), -(2**63) + rng.randrange(4)]), [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(20)]
    rows += [(i, [0.5, -0.25, 1.0]) for i in range(101, 131)]  # ties, more than are asked for
    rows += [(7, [0.5, -0.25, 1.0])] * 9 + [(8, [0.5, -0.25, 1.0])] * 3  # repeated rows
    rows += [(2, None), (4, [1.0, None]), (6, [math.nan]), (10, [math.inf]), (12, []), (14, [2.0]), (16, [1.0, 2.0, 3.0, 4.0]), (18, [0.0, 0.0])]
    assert searched(spark, rows, 6, bins=bins, block=block) == sorted_all(rows, 6)


def test_few_rows_none_and_no_queries(spark):
    rows = [(2, [1.0]), (3, [2.0]), (None, [2.0])]
    assert searched(spark, rows, 20) == [(2, 1, 3, 64 * 128), (2, 2, None, 64 * 128)]
    assert searched(spark, [(2, [1.0])], 20) == []
    assert searched(spark, [(3, [1.0]), (5, [1.0])], 20) == []
    assert searched(spark, [], 20) == []


def test_large_components(spark):
    rows = [(2, [float(1 << 20), 3.0]), (3, [float(1 << 21) + 0.5, -7.0]), (5, [float(1 << 21) + 0.5, -7.25])]
    assert searched(spark, rows, 2) == sorted_all(rows, 2)
    with pytest.raises(OverflowError):
        searched(spark, [(2, [1e12]), (3, [1.0])], 2)
    with pytest.raises(Exception, match="too large"):
        searched(spark, [(2, [1e300]), (3, [1.0])], 2)


@pytest.mark.parametrize("scale", [64.0, 1e6, 1e8])
def test_many_rows_in_every_precision(spark, scale):
    """Single, double and whole numbers; a third of the rows share one vector, so that most scores of some queries tie."""
    rng = random.Random(3)
    rows = [(i, [0.5, -0.5, 0.25, 0.5] if rng.random() < 1 / 3 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 7, scale=scale).collect()
    whole = [[math.floor(scale * x) for x in v] for _, v in rows]
    want = []
    for i in range(0, 1500, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], w)), j) for j, w in enumerate(whole) if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:7])]
    assert in_order((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == in_order(want)
