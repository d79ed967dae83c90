"""Dumps: rows are sorted, not slots; lines are numbered and read without a shuffle of their own; tasks are bounded in slots."""

import glob

from pyspark.sql import functions as F

from sparloom.jobs.queries import REGISTRY
from sparloom.operators import layouts
from sparloom.sources import text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matrix(spark):
    return spark.range(900).select((F.col("id") * 7 % 60).alias("row"), (F.col("id") % 11).alias("col"), (F.col("id") / 7).alias("val"))


def test_rows_are_sorted_and_cut_after_that(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "TASK_SLOTS", 100)
    ell = layouts.to_ell(matrix(spark), 64)
    made = text.slot_lines(ell, 64 * 15, "64 11 900 15")
    plan = plan_of(made)
    assert plan.index("Generate explode") < plan.index("Sort [") and plan.count("rangepartitioning") == 1
    text.save_ell_dump(ell, 64, 11, 900, 15, f"{tmp_path}/ell")
    files = sorted(glob.glob(f"{tmp_path}/ell/part-*"))
    assert len(files) == 10
    want = sorted((r.row, r.slot, r.col, r.val) for r in layouts.to_slots(ell).collect())
    assert "".join(open(f).read() for f in files) == "64 11 900 15\n" + "".join("%d %d %20.19g\n" % (r, c, v) for r, _, c, v in want)
    rows, *sizes = text.read_ell_dump(spark, f"{tmp_path}/ell")
    assert sizes == [64, 11, 900, 15] and sorted(rows.collect()) == sorted(ell.select("row", "ja", "vals").collect())


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    parts = ["\na\n\nb\n", "", "c\n" * 3000, "d\n\n"]
    for i, x in enumerate(parts):
        (tmp_path / f"part-{i}").write_text(x)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = text.numbered_lines(spark, str(tmp_path))
        assert "rangepartitioning" not in plan_of(found) and "hashpartitioning" not in plan_of(found)
        assert [r.value for r in found.orderBy("at").collect()] == "".join(parts).split("\n")[:-1]
        assert [r.at for r in found.select("at").orderBy("at").collect()] == list(range(3006))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_whose_lines_lie_apart(spark, tmp_path):
    (tmp_path / "part-0").write_text("\n2 9 4 2\n0 1 1\n1 2 2\n\n1 3 3\n")
    (tmp_path / "part-1").write_text("0 4 4\n")
    rows, *_ = text.read_ell_dump(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, [1, 4], [1.0, 4.0]), (1, [2, 3], [2.0, 3.0])]
    assert dict(text._dump(spark, str(tmp_path), 4)[1].dtypes)["seq"] == "bigint"


def test_csr_dump_lines_keeps_no_sorted_copy_of_its_lines(spark):
    found = REGISTRY["csr_dump_lines"](spark, "/root/testdata/sf0.001")
    plan = plan_of(found)
    assert "FileScan text" in plan and "rangepartitioning" not in plan
    assert sorted(r.ordinal for r in found.collect()) == list(range(1, 6001))
