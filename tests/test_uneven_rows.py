"""Long rows, large capacities, forced joins and rounded products."""

import random
import warnings

import numpy as np
import pytest

from sparloom.operators import layouts, product, ranges
from sparloom.sources import matrix_market as mm


def entries_of(spark, found):
    return spark.createDataFrame(found, "row long, col long, val double")


def test_slots_of_a_long_row(spark):
    coo = entries_of(spark, [(0, c, float(c + 1)) for c in range(3_000)] + [(2, 5, 7.0)])
    got = layouts.ell_slot_rows(coo, 3)
    assert got.count() == 3 * 3_000
    rows = {(r.row, r.slot): (r.col, r.val) for r in got.where("row > 0 or slot in (0, 2999)").collect()}
    assert rows[0, 0] == (0, 1.0) and rows[0, 2999] == (2999, 3000.0) and rows[2, 0] == (5, 7.0)
    assert {rows[1, s] for s in range(3_000)} == {rows[2, s] for s in range(1, 3_000)} == {(0, 0.0)}
    with pytest.raises(layouts.PaddingError):
        layouts.to_ell(entries_of(spark, [(0, c, 1.0) for c in range(200)]), 1000)


def test_states_by_intervals():
    rng = random.Random(1)
    for _ in range(300):
        each = np.array([rng.choice([0, 0, 1, 2, 3, 9, 30]) for _ in range(rng.randint(1, 12))])
        capacity = rng.choice([1, 2, 5, 16, 40, 100])
        sums, _, state = ranges._walk(each, capacity)
        least, states = ranges._exits(sums, state, capacity)
        assert least[0] == 0 and len(least) <= 2 * len(each) + 1
        for entry in range(capacity):
            p = ranges._enter(sums, entry, capacity)
            found = states[np.searchsorted(least, entry, "right") - 1]
            assert (entry + sums[-1] if found == ranges.OPEN else found) == (state[p] if p >= 0 else entry + sums[-1])
    sums, _, state = ranges._walk(np.ones(50, np.int64), 10**7)
    assert len(ranges._exits(sums, state, 10**7)[0]) < 60


def test_large_capacity(spark):
    nnz = spark.range(5_000).selectExpr("id AS row", "1000L AS nnz")
    blocks = ranges.capacity_blocks(nnz, 5_000, 1_000_000, 512).orderBy("block").collect()
    assert [(r.start_row, r.end_row) for r in blocks] == [(1000 * i, 1000 * i + 1000) for i in range(5)]


def test_nonzeros_are_counted_once(spark):
    """Jobs read the written counts: the source is computed by one of them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    nnz = spark.range(4_000).selectExpr("id AS row", "id % 7 AS nnz").mapInPandas(count, "row long, nnz long")
    assert ranges.balanced_ranges(nnz, 4_000, 12).count() == 12
    assert seen.value <= 2 * 4_000  # the range partitioning looks at a sample first


def test_forced_joins_and_rounding(spark):
    coo = entries_of(spark, [(0, 0, 0.1), (1, 1, 3.0)])
    x = spark.createDataFrame([(0, [1.0, 3.0]), (1, [2.0, 1.0])], "row long, x array<double>")
    shuffled = product.spmm(coo, x, 2, 2, 2, strategy="shuffled")
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    want = [0.1, 3 * 0.1, 6.0, 3.0]
    assert [v for r in shuffled.orderBy("row").collect() for v in r.x] == pytest.approx(want)
    single = product.spmm(coo, x, 2, 2, 2, dtype="float").orderBy("row").collect()
    assert single[0].x == [float(np.float32(v)) for v in (0.1, 3 * 0.1)] and single[0].x != want[:2]
    with pytest.raises(ValueError, match="broadcast"):
        product.spmm(coo, x, 2, 2, strategy="broadcast")


def test_dense_preview_and_half_read(spark, tmp_path):
    x = spark.createDataFrame([(1, [5.0, 6.0]), (0, [1.0, 2.0])], "row long, x array<double>")
    assert [tuple(r) for r in layouts.preview(x, 3).collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0)]
    path = tmp_path / "skew.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        coo, _ = mm.read_mm(spark, str(path))
    assert any("half" in str(w.message) for w in said) and [(r.row, r.col, r.val) for r in coo.collect()] == [(1, 0, 3.0)]
