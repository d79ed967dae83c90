"""Text is read once, and values of a dense file aren't shuffled where lines are rows."""

import random

import pytest

from sparloom.meta import MatrixFormatError
from sparloom.sources import matrix_market as mm
from sparloom.sources import text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def put(tmp_path):
    def write(body, name="a.mtx"):
        path = tmp_path / name
        path.write_text(body)
        return str(path)

    return write


@pytest.mark.parametrize("symmetry", ["general", "symmetric"])
def test_entries_come_from_the_parsed_table(spark, put, symmetry):
    body = "".join(f"{i % 50 + 1} {i % 7 + 1} {i % 3}\n% in between\n\n" for i in range(300))
    path = put(f"%%MatrixMarket matrix coordinate real {symmetry}\n50 50 300\n{body}")
    coo, meta = mm.read_mm(spark, path)
    assert "FileScan text" not in plan(coo) and "FileScan parquet" in plan(coo)
    assert meta.nz == coo.count()
    # The file is gone: nothing reads it again.
    put("", "a.mtx")
    assert coo.count() == meta.nz and coo.where("val = 0").count() == 0


def test_errors_come_as_before(spark, put):
    top = "%%MatrixMarket matrix coordinate real general\n2 2 2\n"
    with pytest.raises(MatrixFormatError, match="1 entries instead of 2"):
        mm.read_mm(spark, put(top + "1 1 1\n"))
    with pytest.raises(MatrixFormatError, match="3 entries instead of 2"):
        mm.read_mm_raw(spark, put(top + "1 1 1\n" * 3))
    raw, _ = mm.read_mm_raw(spark, put(top + "1 1 1\n1 1.5 2\n"))
    with pytest.raises(Exception, match="not a bigint: 1.5"):
        raw.collect()
    short, _ = mm.read_mm_raw(spark, put(top + "1 1 1\n2 2\n"))
    with pytest.raises(Exception, match=r"not a double: \(missing\)"):
        short.collect()


def wide(df):
    return [r["x"] for r in df.orderBy("row").collect()]


def flat(rows):
    return [v for x in rows for v in x]


def test_saved_results_are_read_without_a_shuffle(spark, tmp_path):
    y = spark.range(500).selectExpr("id AS row", "array(id * 1.5D, id / 3D, -id * 1e300) AS x")
    text.save_result(y, f"{tmp_path}/y")
    found = text.read_multivector(spark, f"{tmp_path}/y", 500, 3)
    assert "Exchange hash" not in plan(found) and "Python" not in plan(found) and "Window" not in plan(found)
    assert flat(wide(found)) == pytest.approx(flat(wide(y)), rel=1e-15)
    fewer = text.read_multivector(spark, f"{tmp_path}/y", 7, 3)
    assert flat(wide(fewer)) == pytest.approx(flat(wide(y)[:7]), rel=1e-15)
    # Other shapes of the same numbers: rows in several lines, and several rows in a line.
    numbers = flat(wide(y))
    for cols in (1, 2, 4, 5):
        n = len(numbers) // cols
        got = wide(text.read_multivector(spark, f"{tmp_path}/y", n, cols))
        assert flat(got) == pytest.approx(numbers[: n * cols], rel=1e-15)


def test_uneven_lines(spark, put):
    rng = random.Random(8)
    numbers = [float(i) for i in range(2000)]
    body, at = [], 0
    while at < len(numbers):
        n = rng.choice([0, 1, 1, 2, 7, 40])
        body.append(" ".join(f"{v:g}" for v in numbers[at : at + n]) + rng.choice(["", "  ", "\t"]))
        at += n
    path = put("\n".join(body), "x.txt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for cols in (1, 3, 16, 700):
            rows = len(numbers) // cols
            got = wide(text.read_multivector(spark, path, rows, cols))
            assert [len(x) for x in got] == [cols] * rows and [v for x in got for v in x] == numbers[: rows * cols]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="too few"):
        text.read_multivector(spark, path, 2001, 1).collect()
