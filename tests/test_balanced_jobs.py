"""Balanced ranges: jobs do not grow with parts; fetches of any size give the same boundaries."""

import random

import pytest

from sparloom.operators import prefix, ranges
from test_ranges_and_norms import bounds_of, counts, plain_ranges


def jobs_of(spark, call):
    seen = []
    real = ranges._Counts.near
    ranges._Counts.near = lambda self, spans: seen.append(spans) or real(self, spans)
    try:
        return call(), len(seen)
    finally:
        ranges._Counts.near = real


@pytest.mark.parametrize("parts", [2, 16, 150])
def test_one_fetch_for_any_number_of_parts(spark, parts):
    rng = random.Random(parts)
    nnz = [rng.choice([0, 1, 2, 3, 4]) for _ in range(6_000)]
    found, fetches = jobs_of(spark, lambda: ranges.balanced_ranges(counts(spark, nnz), len(nnz), parts))
    assert bounds_of(found) == plain_ranges(nnz, parts) and fetches == 1
    rows = found.orderBy("part").collect()
    assert [r.nnz for r in rows] == [sum(nnz[r.start_row : r.end_row]) for r in rows]


@pytest.mark.parametrize("fetch", [1, 40, 1 << 22])
def test_fetches_of_any_size(spark, monkeypatch, fetch):
    monkeypatch.setattr(ranges, "FETCH", fetch)
    monkeypatch.setattr(prefix, "LEAST_WIDTH", 3)
    rng = random.Random(fetch)
    for heavy in (3, 40, 400):
        nnz = [rng.choice([0, 0, 1, 2, 3, heavy]) for _ in range(60)]
        for parts in (3, 11, 60):
            found, fetches = jobs_of(spark, lambda: ranges.balanced_ranges(counts(spark, nnz), len(nnz), parts))  # noqa: B023
            assert bounds_of(found) == plain_ranges(nnz, parts), (nnz, parts)
            assert fetches >= 1


def test_few_entries_and_none(spark):
    for nnz in ([0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 2, 0, 1]):
        for parts in (1, 3, 6):
            assert bounds_of(ranges.balanced_ranges(counts(spark, nnz), len(nnz), parts)) == plain_ranges(nnz, parts), (nnz, parts)
