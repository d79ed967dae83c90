"""Runs of words against all pairs of places; how many comparisons a Lyndon array takes; texts of every odd kind."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.llm import queries, runs

SF = "/root/testdata/sf0.001"


def all_runs(s, least):
    """By every distance, the stretches that agree with themselves; of equal stretches the smallest distance."""
    found = {}
    for q in range(len(s) // 2, 0, -1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found[i, j - i + q] = q
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda x: (x[0], x[2]))


def suffixes(s):
    smaller, agree = [len(s)] * len(s), [0] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            if s[j:] < s[i:]:
                smaller[i] = j
                while j + agree[i] < len(s) and s[i + agree[i]] == s[j + agree[i]]:
                    agree[i] += 1
                break
    return smaller, agree


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


periodic = st.builds(lambda p, n, at: [x if i not in at else 0 for i, x in enumerate((p * 30)[:n])], st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(0, 60), st.sets(st.integers(0, 59), max_size=3))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=50), st.lists(st.integers(0, 3), max_size=50), periodic, st.integers(0, 60).map(fibonacci)))
def test_lyndon_arrays_and_runs(s):
    assert runs.lyndon(s) == suffixes(s)
    for least in (1, 12):
        assert runs.runs_of(s, least) == all_runs(s, least)


class Counted(int):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    def __ne__(self, other):
        Counted.n += 1
        return int(self) != int(other)

    def __lt__(self, other):
        Counted.n += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("make", [lambda n: [0] * n, fibonacci, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: [(i & -i).bit_length() % 2 for i in range(1, n + 1)], lambda n: (random.Random(1).choices(range(3), k=n // 7) * 8)[:n]])
@pytest.mark.parametrize("sign", [1, -1])
def test_comparisons_grow_with_the_words(make, sign):
    for n in (1000, 16000):
        s = [Counted(sign * x) for x in make(n)]
        Counted.n = 0
        runs.lyndon(s)
        assert Counted.n <= 5 * n


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f " * 2, "a b c d e f " * 3, "x " * 12, "x " * 11, "\x1c \x1d" * 12, "ä ß " * 7 + "日本 " * 15,
    "p q r s t " * 4 + "p q r s u", "  lead " + "k l m " * 5 + "tail  ", "x\n\tx \r\x0bx\x0c" * 5, "n " * 3000 + "end " + "u v " * 4000, "a b c d e f " * 2,
]


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_texts(spark, limit):
    df = spark.createDataFrame([(i, t, f"own {i}", i) for i, t in enumerate(TEXTS)], "id long, text string, runs string, _words long").coalesce(1)
    found = {r["id"]: r for r in runs.find_runs(df, keep=["id", "_words", "runs"], limit=limit).collect()}
    for i, t in enumerate(TEXTS):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t or "") if x]
        want = all_runs(w, 12) if len(w) < 100 else [(0, 3000, 1), (3001, 8000, 2)]
        gone = {x for a, n, q in want for x in range(a + q, a + n)}
        r = found[i]
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["_words"]) == (len(w), want, i)
        assert r["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    every = runs.find_runs(df)
    assert every.columns == ["id", "_words", "n_words", "runs", "collapsed"][:2] + ["n_words", "runs", "collapsed"] or set(every.columns) == {"id", "text", "_words", "n_words", "runs", "collapsed"}
    assert runs.find_runs(df.where("id < 0")).count() == 0


def test_query_keeps_every_row_and_finds_the_periods_made(spark):
    rows = queries.op11_periodic_runs(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    import zlib

    for r in rows:
        w = (docs[r["doc_id"]] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        want = all_runs(w, 12)
        top = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if want else None)


def test_longest_of_equal_runs(spark):
    row = spark.createDataFrame([([(5, 12, 3), (2, 20, 4), (2, 20, 3), (9, 20, 1)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in row.select(runs.longest(F.col("runs"))).collect()] == [(2, 20, 3), None]
