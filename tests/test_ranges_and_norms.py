"""Balanced ranges, capacity blocks and norms: golden cases, and random ones against plain loops."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparloom.operators import compare, entries, layouts, product, ranges
from sparloom.sources.generate import random_multivector


def counts(spark, nnz):
    return spark.createDataFrame(list(enumerate(nnz)), "row long, nnz long")


def bounds_of(df, first="part"):
    rows = df.orderBy(first).collect()
    return [rows[0].start_row] + [r.end_row for r in rows] if rows else [0]


@pytest.mark.parametrize("nnz, parts, want, loads", [([4, 1, 1, 2, 5, 3], 3, [0, 2, 5, 6], [5, 8, 3]), ([4, 1, 1, 2, 5, 3], 4, [0, 1, 4, 5, 6], None), ([1, 20, 1, 1, 1], 3, [0, 1, 1, 5], [1, 0, 23])])
def test_balanced_ranges(spark, nnz, parts, want, loads):
    df = counts(spark, nnz)
    found = ranges.balanced_ranges(df, len(nnz), parts)
    assert bounds_of(found) == want
    got = ranges.part_loads(df, found, len(nnz)).orderBy("part").collect()
    assert loads is None or [r.load for r in got] == loads
    assert got[0].imbalance == pytest.approx(max(r.load for r in got) * parts / sum(nnz))


@pytest.mark.parametrize("nnz, capacity, want", [([4, 1, 1, 2, 5, 3], 5, [0, 2, 4, 5, 6]), ([3, 3], 5, [0, 2]), ([0, 0, 7, 0, 2, 3, 0, 1], 5, [0, 2, 3, 6, 8]), ([9], 5, [0, 1])])
def test_capacity_blocks(spark, nnz, capacity, want):
    for chunk in (1, 2, 3, 100):
        assert bounds_of(ranges.capacity_blocks(counts(spark, nnz), len(nnz), capacity, chunk), "block") == want


def plain_blocks(nnz, capacity):
    m, bounds, s, total, r = len(nnz), [0], 0, 0, 0
    while r < m - 1:
        total += nnz[r]
        if total >= capacity:
            end = r if total > capacity and r > s else r + 1
            bounds.append(end)
            s, total, r = end, 0, end
        else:
            r += 1
    return bounds + [m]


def plain_ranges(nnz, parts):
    m, nz, bounds = len(nnz), sum(nnz), [0]
    parts = min(parts, m)
    for i in range(1, parts):
        quota = (i + 1) * nz // parts - i * nz // parts
        total, end = 0, m
        for j in range(bounds[-1], m):
            if total + nnz[j] >= quota:
                end = j + 1 if total + nnz[j] - quota < quota - total else j
                break
            total += nnz[j]
        bounds.append(end)
    return bounds + [m]


def test_random_ranges_against_loops(spark, monkeypatch):
    monkeypatch.setattr("sparloom.operators.prefix.LEAST_WIDTH", 3)
    rng = random.Random(5)
    for _ in range(3):
        nnz = [rng.choice([0, 0, 1, 2, 3, 9, 30]) for _ in range(rng.randint(1, 40))]
        df = counts(spark, nnz).cache()
        for parts in (1, 3, 7):
            assert bounds_of(ranges.balanced_ranges(df, len(nnz), parts)) == plain_ranges(nnz, parts), (nnz, parts)
        for capacity in (1, 5, 16):
            blocks = ranges.capacity_blocks(df, len(nnz), capacity, 4)
            assert bounds_of(blocks, "block") == plain_blocks(nnz, capacity), (nnz, capacity)
        placed = ranges.assign_parts(df, blocks.withColumnRenamed("block", "part"), len(nnz)).collect()
        assert sorted(r.row for r in placed) == list(range(len(nnz)))


def test_default_sizes():
    assert ranges.default_capacity(16, 6) == 32 and ranges.default_capacity(10**6, 10) == 1024
    assert [layouts.hack_rows(*x) for x in [(5, 3), (15000, 13), (100, 663), (40, 1)]] == [8, 64, 32, 64]


@pytest.mark.parametrize("a, b, want", [([0, 2, -4], [0, 2, -4], (0, 0)), ([1, 10], [1.5, 10], (0.5, 0.5 / 1.5)), ([0], [3], (3, 1)), ([1], [math.nan], (math.nan, math.nan))])
def test_error_norms(spark, a, b, want):
    dense = lambda v: spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(v)], "row long, x array<double>")
    got = compare.error_norms(dense(a), dense(b)).first()
    assert tuple(got) == pytest.approx(want, nan_ok=True)


def test_missing_rows_count_as_zero(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0])], "row long, x array<double>")
    b = spark.createDataFrame([(0, [1.0]), (5, [-3.0])], "row long, x array<double>")
    assert tuple(compare.error_norms(a, b).first()) == (3.0, 1.0)
    none = a.where("row < 0")
    assert tuple(compare.error_norms(none, none).first()) == (0.0, 0.0)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5), st.integers(1, 9)), max_size=25), st.sampled_from([1, 3, 40]))
def test_layouts_and_strategies_agree(spark, found, k):
    coo = spark.createDataFrame([(r, c, float(v)) for r, c, v in found], "row long, col long, val double")
    x = spark.createDataFrame([(c, [float(c + z) for z in range(k)]) for c in range(6)], "row long, x array<double>")
    want = [[0.0] * k for _ in range(7)]
    for r, c, v in found:
        for z in range(k):
            want[r][z] += v * (c + z)
    hll, _ = layouts.to_hll(coo, 7)
    for layout in (layouts.to_csr(coo, 7), layouts.to_ell(coo, 7, limit=1e9), hll):
        assert sorted((r.row, r.col, r.val) for r in layouts.from_layout(layout).collect()) == sorted((r, c, float(v)) for r, c, v in found)
    for y in (product.spmm(coo, x, 7, k, 6), product.spmm(coo, x, 7, k, strategy="blocks"), product.spmm(coo, x, 7, k, strategy="columns"), product.spmm_layout(hll, x, 7, k)):
        assert [r.x for r in y.orderBy("row").collect()] == want


def test_wide_padding_is_refused(spark):
    coo = spark.range(200).selectExpr("0L AS row", "id AS col", "1D AS val")
    with pytest.raises(layouts.PaddingError):
        layouts.to_ell(coo, 1000)
    assert layouts.to_hll(coo, 1000)[0].count() == 1000


def test_reshapes(spark):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 5.0])], "row long, x array<double>")
    assert sorted(entries.to_wide(entries.to_long(x), 2).collect()) == sorted(x.collect())


def test_random_multivector_does_not_depend_on_partitions(spark):
    a = random_multivector(spark, 50, 3, 7).orderBy("row").collect()
    assert a == random_multivector(spark, 50, 3, 7).repartition(5).orderBy("row").collect()
    numbers = [v for r in a for v in r.x]
    assert all(0 <= v <= 1 for v in numbers) and len(set(numbers)) > 140 and 0.3 < sum(numbers) / 150 < 0.7
    assert a != random_multivector(spark, 50, 3, 8).orderBy("row").collect()
