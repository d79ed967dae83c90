"""Maps of states composed in any grouping, and blocks cut by many runs in several levels of groups."""

import functools
import random

import numpy as np
import pytest

from sparloom.operators import ranges


def plain_blocks(nnz, capacity):
    bounds, s, total, r = [0], 0, 0, 0
    while r < len(nnz) - 1:
        total += nnz[r]
        if total >= capacity:
            end = r if total > capacity and r > s else r + 1
            bounds.append(end)
            s, total, r = end, 0, end
        else:
            r += 1
    return bounds + [len(nnz)]


def map_of(each, capacity):
    sums, _, state = ranges._walk(np.array(each), capacity)
    return (int(state[0]), int(sums[-1]), *ranges._exits(sums, state, capacity))


def test_composed_maps_are_those_of_longer_runs():
    rng = random.Random(2)
    for _ in range(400):
        runs = [[rng.choice([0, 0, 1, 2, 3, 9, 30]) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 6))]
        capacity = rng.choice([1, 2, 5, 16, 40, 100])
        maps = [map_of(r, capacity) for r in runs]
        states = np.arange(-1, capacity)
        one_by_one = states
        for m in maps:
            one_by_one = ranges._after(one_by_one, m)
        left = functools.reduce(ranges._compose, maps)
        right = functools.reduce(lambda a, b: ranges._compose(b, a), maps[::-1])
        whole = map_of(sum(runs, []), capacity)
        for m in (left, right, whole):
            assert ranges._after(states, m).tolist() == one_by_one.tolist()
            assert len(m[2]) <= capacity and m[1] == sum(map(sum, runs))


def test_last_block_by_doubling():
    """A block a row: as many blocks as rows, in a few steps."""
    sums, ends, state = ranges._walk(np.full(1 << 20, 7), 7)
    assert (state == -1).all() and ends.tolist() == list(range(1, (1 << 20) + 1))


@pytest.mark.parametrize("group, chunk", [(2, 3), (3, 1), (64, 5)])
def test_blocks_over_levels_of_groups(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(ranges, "GROUP", group)
    rng = random.Random(group)
    nnz = [rng.choice([0, 0, 1, 2, 3, 9, 30]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(nnz)), "row long, nnz long")
    for capacity in (5, 33):
        blocks = ranges.capacity_blocks(df, len(nnz), capacity, chunk).orderBy("block").collect()
        assert [b.start_row for b in blocks] + [len(nnz)] == plain_blocks(nnz, capacity)


def test_counts_are_made_once_and_the_driver_sees_no_runs(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    nnz = spark.range(3_000).selectExpr("id AS row", "id % 7 AS nnz").mapInPandas(count, "row long, nnz long")
    assert ranges.capacity_blocks(nnz, 3_000, 50, 256).count() > 150
    assert seen.value == 3_000
