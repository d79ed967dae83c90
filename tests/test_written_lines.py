"""Lines of files are made after the sort, once for each row."""

import glob

from pyspark.sql import functions as F

from sparloom.functions.numbers import printf
from sparloom.sources import text


def test_lines_are_made_above_the_sort(spark):
    body = spark.range(1000).select("id", (F.col("id") / 7).alias("val"))
    made = text.lines_in_order(body, ["id"], F.concat_ws(" ", F.col("id").cast("string"), printf(F.col("val"), "%.16g")), ["top", "size"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Sort")
    assert [r.line for r in made.collect()] == ["top", "size", *[f"{i} {i / 7:.16g}" for i in range(1000)]]


def test_rows_of_a_dense_file(spark, tmp_path):
    rows = [(3, [0.1, None, -2.0]), (1, [float("nan"), float("inf"), 1e-300]), (2, []), (0, None), (5, [1.0])]
    text.save_result(spark.createDataFrame(rows, "row long, x array<double>"), str(tmp_path / "y"))
    got = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/y/part-*")))
    assert got == "nan inf 1e-300 \n0.1 nan -2 \n1 \n"
