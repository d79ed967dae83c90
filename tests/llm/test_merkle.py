"""The manifest against trees built level by level, with superblocks so small that many levels of them are reduced."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparloom.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, place, fanout):
    out = []
    for nodes in levels[:-1]:
        run = place // fanout * fanout
        out.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + fanout])))
        place //= fanout
    return out


def expected(rows, fanout):
    by = {}
    for source, order, leaf in rows:
        by.setdefault(source, []).append((order is not None, order or 0, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])], fanout) for s in names}
    top = tree([trees[s][-1][0] for s in names], fanout)
    want = []
    for at, s in enumerate(names):
        for place, (known, order, leaf) in enumerate(sorted(by[s])):
            proof = way(trees[s], place, fanout) + way(top, at, fanout)
            want.append((s, order if known else None, leaf, place, proof, trees[s][-1][0], top[-1][0]))
    return want


def rows_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "source string, doc_id long, leaf string, root string, _at long")
    out = merkle.manifest(df, **how)
    return out, [(r["source"], r["doc_id"], r["leaf"], r["place"], list(zip(r["lefts"], r["rights"])), r["subroot"], r["root"]) for r in out.collect()]


def key(r):
    return (r[0] or "", r[0] is None, r[3])


@pytest.mark.parametrize("fanout,levels", [(3, 1), (2, 2), (3, 7), (5, 1)])
def test_against_plain_trees(spark, fanout, levels):
    rng = random.Random(fanout)
    rows = [("hot", rng.randrange(-50, 200), digest(str(i))) for i in range(120)]
    rows += [(None, i, digest(f"n{i}")) for i in range(4)] + [("", None, digest("x"))] * 3 + [("é", 1, digest("y")), ("z", 2, digest("z"))]
    rows += [(f"s{i}", i, digest(f"s{i}")) for i in range(20)]
    rows += [("hot", 3, digest("same"))] * 5
    out, got = rows_of(spark, rows, fanout=fanout, levels=levels)
    assert sorted(got, key=key) == sorted(expected(rows, fanout), key=key)
    assert out.columns == ["source", "doc_id", "leaf", "_at", "place", "lefts", "rights", "subroot", "root"]
    folded = out.select("root", merkle.fold(F.col("leaf"), F.col("lefts"), F.col("rights")).alias("f"), merkle.fold(F.sha2("leaf", 256), F.col("lefts"), F.col("rights")).alias("g")).collect()
    assert all(r["f"] == r["root"] != r["g"] for r in folded)


def test_one_leaf_and_none(spark):
    one = [("a", 1, digest("q"))]
    assert rows_of(spark, one)[1] == [("a", 1, digest("q"), 0, [], digest("q"), digest("q"))]
    assert rows_of(spark, [])[1] == []
    singles = [(c, 1, digest(c)) for c in "abcd"]
    assert sorted(rows_of(spark, singles)[1]) == sorted(expected(singles, 3))


def test_fields(spark):
    df = spark.createDataFrame([(1, None, "é\n", None), (None, "", "x" * 70000, 2)], "doc_id long, source string, text string, n long")
    got = [r[0] for r in df.select(merkle.leaf([F.col(c) for c in ("doc_id", "source", "text", "n")])).collect()]
    assert got == [digest("1:1-3:é\n-"), digest("-0:" + "70000:" + "x" * 70000 + "1:2")]
