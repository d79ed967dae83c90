"""Golden matrix files: what the loader, layouts, products, reports and writers make of them."""

import pytest
from pyspark.errors import PySparkException

from sparloom.jobs.workloads import run
from sparloom.meta import MatrixFormatError, MatrixMeta, check_supported, is_valid_typecode
from sparloom.operators import entries, layouts, prefix, product, report
from sparloom.sources import matrix_market as mm
from sparloom.sources import text

GENERAL = """%%MatrixMarket matrix coordinate real general
% comment
5 4 8
1 1 2.0
3 1 1.0
5 1 4.0
1 2 3.0
3 2 0.0
3 3 5.0
5 3 -1.0
5 4 6.0
"""
SYMMETRIC = """%%MatrixMarket matrix coordinate pattern symmetric
3 3 3
1 1
2 1
3 2
"""


@pytest.fixture
def put(tmp_path):
    def write(body, name="a.mtx"):
        path = tmp_path / name
        path.write_text(body)
        return str(path)

    return write


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row long, x array<double>")


def wide(y):
    return [r.x for r in y.orderBy("row").collect()]


def banner(kind):
    return f"%%MatrixMarket matrix {kind}\n"


def test_general_file(spark, put):
    coo, meta = mm.read_mm(spark, put(GENERAL))
    assert (meta.m, meta.n, meta.nz) == (5, 4, 7)
    assert sorted((r.row, r.col, r.val) for r in coo.collect()) == [(0, 0, 2), (0, 1, 3), (2, 0, 1), (2, 2, 5), (4, 0, 4), (4, 2, -1), (4, 3, 6)]
    assert [r.row for r in entries.empty_rows(coo, 5).orderBy("row").collect()] == [1, 3]
    assert [r.irp for r in prefix.row_pointers(entries.all_row_nnz(coo, 5), 5).orderBy("row").collect()] == [0, 2, 2, 4, 4, 7]
    profile = report.matrix_profile(coo, 5, 4).first()
    assert (profile.maxnz, profile.avg_nnz, profile.nz, profile.empty_rows) == (3, 2, 7, 2)
    ell = layouts.to_ell(coo, 5).orderBy("row").collect()
    assert [(r.ja, r.vals) for r in ell] == [([0, 1, 0], [2, 3, 0]), ([0, 0, 0], [0, 0, 0]), ([0, 2, 0], [1, 5, 0]), ([0, 0, 0], [0, 0, 0]), ([0, 2, 3], [4, -1, 6])]
    rows, directory = layouts.to_hll(coo, 5, 2)
    assert [(r.maxnz, r.hack_offset, r.n_rows, r.first_row) for r in directory.orderBy("hack").collect()] == [(2, 0, 2, 0), (2, 4, 2, 2), (3, 8, 1, 4)]
    assert [len(r.ja) for r in rows.orderBy("row").collect()] == [2, 2, 2, 2, 3]
    assert [r.hack_offset for r in prefix.hack_offsets(directory, 3).orderBy("hack").collect()] == [0, 4, 8, 11]
    x = vectors(spark, [[1, 2], [3, 4], [5, 6], [7, 8]])
    want = [[11, 16], [0, 0], [26, 32], [0, 0], [41, 50]]
    for y in (product.spmm(coo, x, 5, 2), product.spmm(coo, x, 5, 2, 4), product.spmm(coo, x, 5, 2, strategy="blocks"), product.spmm(coo, x, 5, 2, 4, strategy="broadcast"), product.spmm_layout(rows, x, 5, 2), product.spmm_layout(layouts.to_csr(coo, 5), x, 5, 2)):
        assert wide(y) == want
    assert report.flops(7, 2) == 28
    assert report.footprint(coo, directory, 5, 4, 2).first() == (108, 180, 156, 144)
    assert report.footprint(coo, directory, 5, 4, 2, "float", blocks=3).first() == (4 * 6 + 8 * 7 + 16, 120, 24 + 88, 72)
    ratio = report.padding_ratio(coo, directory, 5).first()
    assert (ratio.ell_slots, ratio.hll_slots) == (15, 11)
    assert ratio.ell_ratio == pytest.approx(15 / 7)
    assert [(r.row, r.slot, r.col, r.val) for r in layouts.preview(layouts.to_csr(coo, 5), 3).collect()] == [(0, 0, 0, 2), (0, 1, 1, 3), (2, 0, 0, 1)]


def test_symmetric_pattern(spark, put):
    path = put(SYMMETRIC)
    raw, _ = mm.read_mm_raw(spark, path)
    assert sorted((r.row, r.col) for r in raw.collect()) == [(1, 1), (2, 1), (3, 2)] and "val" not in raw.columns
    coo, meta = mm.read_mm(spark, path)
    assert meta.nz == 5
    csr = layouts.to_csr(coo, 3).orderBy("row").collect()
    assert [(r.irp, r.ja) for r in csr] == [(0, [0, 1]), (2, [0, 2]), (4, [1])]
    assert wide(product.spmm(coo, vectors(spark, [[1, 2], [3, 4], [5, 6]]), 3, 2)) == [[4, 6], [6, 8], [3, 4]]


def test_duplicates_and_file_order(spark, put):
    coo, meta = mm.read_mm(spark, put(banner("coordinate real general") + "2 2 4\n2 2 1.5\n1 1 1\n2 2 2.5\n2 1 4\n"))
    row = layouts.to_csr(coo, 2).where("row = 1").first()
    assert (meta.nz, row.ja, row.vals) == (4, [1, 1, 0], [1.5, 2.5, 4])
    assert [(r.slot, r.col) for r in layouts.slots(coo).where("row = 1").orderBy("slot").collect()] == [(0, 1), (1, 1), (2, 0)]
    assert wide(product.spmm(coo, vectors(spark, [[1], [10]]), 2, 1)) == [[1], [44]]


@pytest.mark.parametrize(
    "body, message",
    [
        ("%%matrixmarket matrix coordinate real general\n1 1 0\n", "no header"),
        ("%%MatrixMarket matrix coordinate real\n1 1 0\n", "premature end"),
        (banner("coordinate quaternion general") + "1 1 0\n", "unsupported"),
        (banner("array real general") + "2 2\n1\n2\n3\n4\n", "coordinate"),
        (banner("coordinate complex general") + "1 1 1\n1 1 1 2\n", "complex"),
        (banner("coordinate real hermitian") + "1 1 1\n1 1 1\n", "invalid"),
        (banner("coordinate real general") + "2 2 2\n1 1 1\n", "premature end"),
        (banner("coordinate real general") + "2 2 1\n1 1 1\n2 2 1\n", "2 entries"),
        (banner("coordinate real general"), "premature end"),
        ("", "premature end"),
    ],
)
def test_refused(spark, put, body, message):
    with pytest.raises(MatrixFormatError, match=message):
        mm.read_mm(spark, put(body))


def test_unreadable_number(spark, put):
    with pytest.raises(PySparkException, match="not a double"):
        mm.read_mm(spark, put(banner("coordinate real general") + "1 1 1\n1 1 x\n"))[0].collect()


def test_accepted_headers(spark, put):
    meta = mm.read_mm_header(spark, put("%%MatrixMarket MATRIX Coordinate REAL General\n% c\n\n 3 4 0\n"))
    assert (meta.format, meta.field, meta.m, meta.n, meta.nz) == ("coordinate", "real", 3, 4, 0)
    dense = mm.read_mm_header(spark, put(banner("array real general") + "2 3\n", "b.mtx"))
    assert (dense.m, dense.n, dense.nz) == (2, 3, None)


def test_values_and_kinds(spark, put):
    coo, meta = mm.read_mm(spark, put(banner("coordinate real skew-symmetric") + "2 2 3\n2 1 -0.0\n2 1 1e-3\n2 2 nan\n"))
    assert meta.nz == 2 and coo.where("val = 0.001").count() == 1 and coo.where("isnan(val)").count() == 1
    path = put(banner("coordinate integer general") + "2 2 1\n2 1 7\n", "i.mtx")
    assert mm.read_mm(spark, path)[0].first().val == 7.0
    with pytest.raises(MatrixFormatError, match="integer"):
        mm.read_mm_raw(spark, path)
    raw, _ = mm.read_mm_raw(spark, put(banner("coordinate complex general") + "1 1 1\n1 1 1.5 -2\n", "c.mtx"))
    assert (raw.first().re, raw.first().im) == (1.5, -2.0)
    single, _ = mm.read_mm(spark, put(banner("coordinate real general") + "1 1 1\n1 1 0.1\n", "f.mtx"), "float")
    assert single.first().val == pytest.approx(0.1, abs=1e-8) and single.first().val != 0.1
    half, _ = mm.read_mm_unsymmetric(spark, put(banner("coordinate real symmetric") + "2 2 1\n2 1 3\n", "u.mtx"))
    assert [(r.row, r.col, r.val) for r in half.collect()] == [(1, 0, 3.0)]


def test_typecodes():
    bad = [("array", "pattern", "general"), ("coordinate", "real", "hermitian"), ("coordinate", "pattern", "skew-symmetric"), ("coordinate", "pattern", "hermitian")]
    assert not any(is_valid_typecode(MatrixMeta(format=a, field=b, symmetry=c)) for a, b, c in bad)
    assert is_valid_typecode(MatrixMeta(field="complex", symmetry="hermitian"))
    with pytest.raises(MatrixFormatError):
        check_supported(MatrixMeta(format="array"))


def test_entry_like_the_size_line(spark, put):
    coo, meta = mm.read_mm(spark, put(banner("coordinate real general") + "5 4 2\n5 4 2\n1 1 3\n"))
    assert meta.nz == 2 and sorted((r.row, r.col, r.val) for r in coo.collect()) == [(0, 0, 3), (4, 3, 2)]


def test_many_splits_keep_file_order(spark, put):
    n = 3000
    body = "".join(f"1 {(7 * i) % n + 1} {i + 1}\n" for i in range(n))
    path = put(banner("coordinate real general") + f"1 {n} {n}\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        coo, _ = mm.read_mm(spark, path)
        row = layouts.to_csr(coo, 1).first()
        numbers = text.read_multivector(spark, put("".join(f"{i} " + "\n" * (i % 3) for i in range(4000)), "x.txt"), 999, 4).orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert row.vals == [float(i + 1) for i in range(n)]
    assert [v for r in numbers for v in r.x] == [float(i) for i in range(3996)]


def test_too_few_numbers(spark, put):
    with pytest.raises(PySparkException, match="too few"):
        text.read_multivector(spark, put("1 2 3", "x.txt"), 2, 2).collect()


def joined(folder):
    import glob

    return "".join(open(f).read() for f in sorted(glob.glob(f"{folder}/part-*")))


def test_written_forms(spark, put, tmp_path):
    coo, meta = mm.read_mm(spark, put(GENERAL))
    one_based = coo.withColumns({"row": coo.row + 1, "col": coo.col + 1})
    mm.write_mm(one_based, meta, f"{tmp_path}/out")
    written = joined(f"{tmp_path}/out").splitlines()
    assert written[:3] == ["%%MatrixMarket matrix coordinate real general", "5 4 7", "1 1 %20.16g" % 2.0]
    again, _ = mm.read_mm(spark, f"{tmp_path}/out")
    assert sorted(again.select("row", "col", "val").collect()) == sorted(coo.select("row", "col", "val").collect())
    y = vectors(spark, [[0.1, 2], [1e300, -2.5]])
    text.save_result(y, f"{tmp_path}/y")
    assert joined(f"{tmp_path}/y") == "".join("".join("%.16g " % v for v in r) + "\n" for r in ([0.1, 2], [1e300, -2.5]))
    assert wide(text.read_multivector(spark, f"{tmp_path}/y", 2, 2)) == [[0.1, 2], [1e300, -2.5]]
    text.save_csr_dump(layouts.to_csr(coo, 5), 5, 4, 7, f"{tmp_path}/csr")
    lines = joined(f"{tmp_path}/csr").splitlines()
    assert lines[0] == "5 4 7" and lines[1] == "0 0 %20.19g" % 2.0 and len(lines) == 8
    found, m, n, nz = text.read_csr_dump(spark, f"{tmp_path}/csr")
    assert [r.irp for r in layouts.to_csr(found, m).orderBy("row").collect()] == [0, 2, 2, 4, 4]
    text.save_ell_dump(layouts.to_ell(coo, 5), 5, 4, 7, 3, f"{tmp_path}/ell")
    assert len(joined(f"{tmp_path}/ell").splitlines()) == 16
    rows, *sizes = text.read_ell_dump(spark, f"{tmp_path}/ell")
    assert sizes == [5, 4, 7, 3] and rows.orderBy("row").collect() == layouts.to_ell(coo, 5).orderBy("row").collect()
    with pytest.raises(MatrixFormatError):
        text.read_ell_dump(spark, f"{tmp_path}/csr")
    assert text.result_name("/a/m.mtx", 4) == "/a/m_4.txt"


@pytest.mark.parametrize("layout, balance", [("csr", "quota"), ("ell", "quota"), ("hll", "capacity")])
def test_workloads(spark, put, layout, balance):
    got = run(spark, put(GENERAL), 3, layout, parts=2, save=layout == "csr", balance=balance)
    assert got.errors.first().abs_error == 0 and got.flops == 2 * 3 * 7
    assert sum(r.load for r in got.loads.collect()) == 7
    if got.saved:
        for a, b in zip(wide(got.y), wide(text.read_multivector(spark, got.saved, 5, 3)), strict=True):
            assert a == pytest.approx(b, rel=1e-15)
