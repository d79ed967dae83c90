"""Rows cut into segments: one row with a third of the entries, no array above the bound, and no window over a row."""

import random

import pytest
from pyspark.sql import functions as F

from sparloom.operators import layouts, prefix, product
from sparloom.sources import text

N = 60_000


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 entries of 50 rows, of which row 7 has a third; rows 3 and 49 are empty. Values are whole, so sums are exact."""
    id_ = F.col("id")
    other = F.pmod(id_ * 48271, F.lit(49))
    row = F.when(id_ % 3 == 0, 7).when(other == 3, 4).otherwise(other).cast("long")
    return spark.range(N).select(row.alias("row"), F.pmod(id_ * 16807, F.lit(20_011)).alias("col"), (id_ % 9 + 1).cast("double").alias("val"))


def plain(hot):
    rows = {r: [] for r in range(50)}
    for r in hot.collect():
        rows[r["row"]].append((r["col"], r["val"]))
    return {r: sorted(v) for r, v in rows.items()}


def test_slots_have_no_window_by_row(spark, hot):
    found = layouts.slots(hot)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = {(r["row"], r["slot"]): (r["col"], r["val"]) for r in found.collect()}
    assert got == {(r, i): e for r, v in plain(hot).items() for i, e in enumerate(v)}


@pytest.mark.parametrize("segment", [64, 1000])
def test_segments_of_a_long_row(spark, hot, segment):
    want = plain(hot)
    csr = layouts.to_csr(hot, 50, segment)
    records = csr.collect()
    assert max(len(r["ja"]) for r in records) == segment
    assert sum(r["row"] == 7 for r in records) == -(-len(want[7]) // segment)
    at = 0
    for row in range(50):
        mine = sorted((r for r in records if r["row"] == row), key=lambda r: r["first_slot"])
        assert [(c, v) for r in mine for c, v in zip(r["ja"], r["vals"])] == want[row]
        assert {r["irp"] for r in mine} == {at} and {r["nnz"] for r in mine} == {len(want[row])}
        assert [r["first_slot"] for r in mine] == list(range(0, max(1, len(want[row])), segment))
        at += len(want[row])
    back = layouts.from_layout(csr)
    assert back.exceptAll(hot).count() == hot.exceptAll(back).count() == 0


def test_padded_segments(spark, hot):
    some = hot.where("col < 600")
    rows, directory = layouts.to_hll(some, 50, 5, 100)
    whole, same = layouts.to_hll(some, 50, 5)
    assert rows.agg(F.max(F.size("ja"))).first()[0] == 100
    a, b = layouts.to_slots(rows), layouts.to_slots(whole).withColumn("slot", F.col("slot").cast("long"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert directory.exceptAll(same).count() == 0
    none = hot.where("row < 0")
    assert [(r["row"], r["ja"]) for r in layouts.to_hll(none, 3, 2, 4)[0].orderBy("row").collect()] == [(r, []) for r in range(3)]
    assert layouts.segment_rows(none, 3).count() == 3


def test_products_dumps_and_previews_of_segments(spark, hot, tmp_path):
    x = spark.range(20_011).select(F.col("id").alias("row"), F.array(F.col("id") % 5 + 0.0, F.col("id") % 7 + 0.0).alias("x"))
    rows = layouts.segment_rows(hot, 50, 100)
    y = {r["row"]: r["x"] for r in product.spmm_layout(rows, x, 50, 2, 20_011).collect()}
    assert y == {r: [float(sum(v * (c % 5) for c, v in e)), float(sum(v * (c % 7) for c, v in e))] for r, e in plain(hot).items()}
    path = str(tmp_path / "dump")
    text.save_csr_dump(rows, 50, 20_011, N, path)
    found, m, n, nz = text.read_csr_dump(spark, path)
    assert (m, n, nz) == (50, 20_011, N)
    assert found.drop("seq").exceptAll(hot).count() == 0
    top = [(r["row"], r["slot"]) for r in layouts.preview(rows, 5).collect()]
    assert top == [(0, i) for i in range(5)]


def test_file_order_is_kept(spark):
    rng = random.Random(3)
    found = [(rng.randrange(3), rng.randrange(9), float(i + 1), (i * 7919) % 1000) for i in range(500)]
    coo = spark.createDataFrame(found, "row long, col long, val double, seq long")
    by = {r: [e[1:3] for e in sorted((e for e in found if e[0] == r), key=lambda e: e[3])] for r in range(3)}
    got = layouts.segment_rows(coo, 3, 7).orderBy("row", "first_slot").collect()
    assert {r: [p for g in got if g["row"] == r for p in zip(g["ja"], g["vals"])] for r in range(3)} == by


def test_no_join_or_shuffle_by_row_alone(spark, hot):
    """Arrays are dealt by row and place; only rows without entries, and counts, are joined by row."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (layouts.to_csr(hot, 50, 64), layouts.segment_rows(hot, 50, 64)):
            cut = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
            first_join = next(i for i, line in enumerate(cut) if "Join Left" in line)
            assert not any("collect_list" in line for line in cut[first_join:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("counts", [prefix.COUNTS, 0])
def test_places(spark, monkeypatch, counts):
    monkeypatch.setattr(prefix, "COUNTS", counts)
    rng = random.Random(counts)
    rows = [(rng.choice("aaab"), rng.randrange(50), i) for i in range(400)] + [("c", 5, 1)] * 30
    df = spark.createDataFrame(rows, "k string, v long, u long")
    got = prefix.places(df, ["k"], ["v", "u"], "at", "of", partitions=7).collect()
    assert sorted((r["k"], r["at"], r["v"], r["u"], r["of"]) for r in got) == [(k, i, v, u, len(of)) for k in "abc" for of in [sorted(r[1:] for r in rows if r[0] == k)] for i, (v, u) in enumerate(of)]
    both = prefix.places(df, ["k"], ["v", "u"], "at", "of", "all", partitions=5).collect()
    assert [(r["k"], r["v"], r["u"]) for r in sorted(both, key=lambda r: r["all"])] == sorted(rows) and sorted(r["all"] for r in both) == list(range(len(rows)))
    every = prefix.places(df, [], ["v", "u"], "at").collect()
    assert [(r["v"], r["u"]) for r in sorted(every, key=lambda r: r["at"])] == sorted(r[1:] for r in rows)
    assert prefix.places(df.where("v < 0"), ["k"], ["v"], "at").count() == 0
