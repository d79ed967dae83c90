"""Sums whose bits don't depend on partitions, strategies or the order of entries."""

import math
import random
from fractions import Fraction

import pytest

from sparloom.operators import compare, product

K = 3


def numbers(seed, wide=False):
    rng = random.Random(seed)
    draw = (lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 9)) if wide else (lambda: rng.uniform(-1, 1))
    entries = [(rng.randrange(20), rng.randrange(200), draw()) for _ in range(6_000)]
    return entries, [(c, [draw() for _ in range(K)]) for c in range(200)]


def bits(y):
    return {r["row"]: [v.hex() for v in r["x"]] for r in y.collect()}


@pytest.mark.parametrize("wide", [False, True])
def test_same_bits_for_1_and_200_partitions(spark, wide):
    found, vectors = numbers(1, wide)
    x = spark.createDataFrame(vectors, "row long, x array<double>")
    seen = []
    for partitions, shuffle, strategy in ((1, 1, "auto"), (200, 7, "auto"), (13, 200, "shuffled"), (5, 4, "blocks"), (9, 4, "split")):
        rows = random.Random(partitions).sample(found, len(found))
        coo = spark.createDataFrame(rows, "row long, col long, val double").repartition(partitions)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
        try:
            seen.append(bits(product.spmm(coo, x, 21, K, 200, strategy=strategy, exact=True)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(s == seen[0] for s in seen)
    # Right to within a rounding of the sum and what the cuts leave out.
    of = dict(vectors)
    bound = max(abs(v) for _, _, v in found) * max(abs(v) for xs in of.values() for v in xs)
    for row in range(20):
        mine = [(c, v) for r, c, v in found if r == row]
        for z in range(K):
            want = sum(Fraction(v * of[c][z]) for c, v in mine)
            assert abs(Fraction(float.fromhex(seen[0][row][z])) - want) <= abs(want) * Fraction(2) ** -52 + len(mine) * Fraction(bound) * Fraction(2) ** -88
    assert seen[0][20] == [0.0.hex()] * K


def test_plain_and_exact_sums_are_within_the_tolerance(spark):
    found, vectors = numbers(2)
    coo, x = spark.createDataFrame(found, "row long, col long, val double"), spark.createDataFrame(vectors, "row long, x array<double>")
    errors = compare.error_norms(product.spmm(coo, x, 20, K, 200), product.spmm(coo, x, 20, K, 200, exact=True)).first()
    assert errors["abs_error"] < 300 * 2.22e-16 * 300


def test_odd_numbers(spark):
    coo = spark.createDataFrame([(0, 0, math.inf), (0, 1, 1.0), (1, 0, math.nan), (2, 1, 5e-324), (3, 1, 1e300), (3, 0, -1e300), (4, 0, 0.0)], "row long, col long, val double")
    x = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "row long, x array<double>")
    y = {r["row"]: r["x"][0] for r in product.spmm(coo, x, 6, 1, 2, exact=True).collect()}
    assert y[0] == math.inf and math.isnan(y[1]) and y[2] == 0.0 and y[3] == 0.0 and y[4] == y[5] == 0.0
    small = coo.where("row = 2")
    assert product.spmm(small, x, 3, 1, 2, exact=True).where("row = 2").first()["x"][0] in (0.0, 5e-324)
    none = coo.where("row < 0")
    assert product.spmm(none, x, 2, 1, 2, exact=True).count() == 2
