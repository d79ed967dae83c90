"""Registered queries: each operator over the bound tables, as flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom import meta as M
from sparloom.jobs import bindings as B
from sparloom.operators import compare, entries, layouts, prefix, product, ranges, report
from sparloom.sources import generate, matrix_market, text

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PARTS = 8
CAPACITY = 200
#: Entries of a segment, and rows of a hack, for the long rows of suppliers.
CUT, CUT_HACK = 128, 8


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def _cells(y: DataFrame) -> DataFrame:
    """A wide result, element by element, as whole numbers."""
    return entries.to_long(y).select("row", _long("z").alias("z"), _long("val").alias("val"))


def _sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    return B.count(spark, d, "orders"), B.count(spark, d, "part")


def _spmm(spark: SparkSession, d: str, k: int = 4, **how) -> DataFrame:
    m, n = _sizes(spark, d)
    return product.spmm(B.order_part(spark, d), B.part_vectors(spark, d, k), m, k, n, **how)


@query
def spmv_order_part(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    v = B.table(spark, d, "part").select(_long("p_partkey").alias("row"), F.col("p_size").cast("double").alias("val"))
    return product.spmv(B.order_part(spark, d), v, m, n).select("row", _long("val").alias("val"))


@query
def spmm_columns_k4(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_spmm(spark, d, strategy="columns"))


@query
def spmm_shuffled_k4(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_spmm(spark, d, strategy="shuffled"))


@query
def spmm_split_k4(spark: SparkSession, d: str) -> DataFrame:
    """One column has half of the entries."""
    m, n = _sizes(spark, d)
    return _cells(product.spmm(B.order_part_hot(spark, d), B.part_vectors(spark, d, 4), m, 4, n, strategy="split"))


@query
def heavy_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns that would fill one of PARTS partitions, and how many entries they have."""
    coo = B.order_part_hot(spark, d)
    found = coo.where(F.col("col").isin(product.heavy_columns(coo, PARTS)))
    return found.groupBy("col").agg(F.count(F.lit(1)).alias("entries"))


@query
def spmm_broadcast_k4(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_spmm(spark, d, strategy="broadcast"))


@query
def spmm_float_k4(spark: SparkSession, d: str) -> DataFrame:
    """Sums of quarters, rounded to single precision."""
    m, n = _sizes(spark, d)
    quarters = B.order_part(spark, d).withColumn("val", F.col("val") / 4)
    return entries.to_long(product.spmm(quarters, B.part_vectors(spark, d, 4), m, 4, n, dtype="float")).select("row", _long("z").alias("z"), "val")


@query
def spmm_exact_k4(spark: SparkSession, d: str) -> DataFrame:
    """Products of numbers that are not whole, with sums that have the same bits in any order."""
    m, n = _sizes(spark, d)
    y = product.spmm(B.order_part_revenue(spark, d), B.part_prices(spark, d, 4), m, 4, n, exact=True)
    return entries.to_long(y).select("row", _long("z").alias("z"), "val")


@query
def spmm_blocks_k64(spark: SparkSession, d: str) -> DataFrame:
    m = B.extent(spark, d, "events", "user_id")
    return _cells(product.spmm(B.user_event(spark, d), B.embedding_vectors(spark, d), m, B.VECTOR, B.VECTORS, strategy="blocks"))


@query
def spmm_csr_k4(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    return _cells(product.spmm_layout(layouts.to_csr(B.order_part(spark, d), m), B.part_vectors(spark, d, 4), m, 4, n))


@query
def spmm_ell_k4(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    return _cells(product.spmm_layout(layouts.to_ell(B.order_part(spark, d), m), B.part_vectors(spark, d, 4), m, 4, n))


@query
def spmm_hll_k4(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    rows, _ = layouts.to_hll(B.order_part(spark, d), m)
    return _cells(product.spmm_layout(rows, B.part_vectors(spark, d, 4), m, 4, n))


def _entry(df: DataFrame) -> DataFrame:
    return df.select("row", "col", _long("val").alias("val"))


@query
def drop_zeros(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.drop_zeros(B.order_part_tax(spark, d)))


@query
def rebase(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.rebase(B.order_part(spark, d).withColumns({"row": F.col("row") + 1, "col": F.col("col") + 1})))


@query
def pattern_values(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.pattern_values(B.order_part(spark, d)))


@query
def mirror_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.mirror_symmetric(B.lower_triangle(spark, d)))


@query
def mirror_union(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.mirror_union(B.lower_triangle(spark, d)))


@query
def adjusted_nz(spark: SparkSession, d: str) -> DataFrame:
    half = B.lower_triangle(spark, d).withColumn("val", F.col("val") % 5)
    return entries.adjusted_nz(half, symmetric=True)


@query
def strip_padding(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.strip_padding(layouts.ell_slot_rows(B.order_part(spark, d), _sizes(spark, d)[0])))


@query
def row_nnz(spark: SparkSession, d: str) -> DataFrame:
    return entries.row_nnz(B.order_part(spark, d))


@query
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return entries.all_row_nnz(B.order_part(spark, d), _sizes(spark, d)[0])


@query
def empty_rows(spark: SparkSession, d: str) -> DataFrame:
    return entries.empty_rows(B.order_part(spark, d), _sizes(spark, d)[0])


@query
def max_nnz(spark: SparkSession, d: str) -> DataFrame:
    return entries.max_nnz(B.order_part(spark, d))


@query
def matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return report.matrix_profile(B.order_part(spark, d), *_sizes(spark, d))


@query
def row_pointers(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _sizes(spark, d)
    return prefix.row_pointers(entries.all_row_nnz(B.order_part(spark, d), m), m)


@query
def entry_slots(spark: SparkSession, d: str) -> DataFrame:
    found = layouts.slots(B.order_part(spark, d))
    return found.select("row", _long("slot").alias("slot"), "col", _long("val").alias("val"))


def _slots(layout: DataFrame) -> DataFrame:
    return layouts.to_slots(layout).select("row", _long("slot").alias("slot"), "col", _long("val").alias("val"))


@query
def csr_slots(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _sizes(spark, d)
    csr = layouts.to_csr(B.order_part(spark, d), m)
    return csr.select("row", "irp", F.posexplode(F.arrays_zip("ja", "vals")).alias("slot", "_e")).select("row", "irp", _long("slot").alias("slot"), F.col("_e.ja").alias("col"), _long("_e.vals").alias("val"))


@query
def ell_slots(spark: SparkSession, d: str) -> DataFrame:
    found = layouts.ell_slot_rows(B.order_part(spark, d), _sizes(spark, d)[0])
    return found.select("row", _long("slot").alias("slot"), "col", _long("val").alias("val"))


@query
def ell_array_slots(spark: SparkSession, d: str) -> DataFrame:
    return _slots(layouts.to_ell(B.order_part(spark, d), _sizes(spark, d)[0]))


@query
def hll_slots(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = layouts.to_hll(B.order_part(spark, d), _sizes(spark, d)[0])
    return _slots(rows)


def _suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    return B.supplier_part(spark, d), B.count(spark, d, "supplier"), B.count(spark, d, "part")


@query
def csr_segments(spark: SparkSession, d: str) -> DataFrame:
    """Long rows, by segments that are shorter than they are."""
    coo, m, _ = _suppliers(spark, d)
    csr = layouts.to_csr(coo, m, CUT)
    flat = csr.select("row", "irp", "nnz", "first_slot", F.posexplode_outer(F.arrays_zip("ja", "vals")).alias("at", "_e"))
    return flat.select("row", "irp", "nnz", (F.col("first_slot") + F.col("at")).alias("slot"), F.col("_e.ja").alias("col"), _long("_e.vals").alias("val"))


@query
def hll_segments(spark: SparkSession, d: str) -> DataFrame:
    coo, m, _ = _suppliers(spark, d)
    rows, _ = layouts.to_hll(coo, m, CUT_HACK, CUT)
    return _slots(rows)


@query
def spmm_segments_k4(spark: SparkSession, d: str) -> DataFrame:
    coo, m, n = _suppliers(spark, d)
    return _cells(product.spmm_layout(layouts.segment_rows(coo, m, CUT), B.part_vectors(spark, d, 4), m, 4, n))


@query
def layout_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = layouts.to_hll(B.order_part(spark, d), _sizes(spark, d)[0])
    return _entry(layouts.from_layout(rows))


@query
def layout_roundtrip_csr(spark: SparkSession, d: str) -> DataFrame:
    return _entry(layouts.from_layout(layouts.to_csr(B.order_part(spark, d), _sizes(spark, d)[0])))


@query
def layout_roundtrip_ell(spark: SparkSession, d: str) -> DataFrame:
    return _entry(layouts.from_layout(layouts.to_ell(B.order_part(spark, d), _sizes(spark, d)[0])))


@query
def hack_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each hack begins, and where the last one ends."""
    coo, (m, _) = B.order_part(spark, d), _sizes(spark, d)
    rows = layouts.hack_rows(m, entries.max_nnz(coo).first()[0])
    return prefix.hack_offsets(layouts.hack_directory(coo, m, rows), -(-m // rows))


@query
def hack_directory(spark: SparkSession, d: str) -> DataFrame:
    coo, (m, _) = B.order_part(spark, d), _sizes(spark, d)
    return layouts.hack_directory(coo, m, layouts.hack_rows(m, entries.max_nnz(coo).first()[0]))


def _part_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    m = B.count(spark, d, "part")
    return entries.all_row_nnz(B.part_supplier(spark, d), m), m


@query
def balanced_ranges(spark: SparkSession, d: str) -> DataFrame:
    nnz, m = _part_rows(spark, d)
    return ranges.balanced_ranges(nnz, m, PARTS)


@query
def part_loads(spark: SparkSession, d: str) -> DataFrame:
    nnz, m = _part_rows(spark, d)
    return ranges.part_loads(nnz, ranges.balanced_ranges(nnz, m, PARTS), m).select("part", "load")


@query
def part_imbalance(spark: SparkSession, d: str) -> DataFrame:
    nnz, m = _part_rows(spark, d)
    return ranges.part_loads(nnz, ranges.balanced_ranges(nnz, m, PARTS), m).select("part", "imbalance")


@query
def assign_parts(spark: SparkSession, d: str) -> DataFrame:
    nnz, m = _part_rows(spark, d)
    return ranges.assign_parts(nnz, ranges.balanced_ranges(nnz, m, PARTS), m)


@query
def capacity_blocks(spark: SparkSession, d: str) -> DataFrame:
    nnz, m = _part_rows(spark, d)
    return ranges.capacity_blocks(nnz, m, CAPACITY)


@query
def capacity_blocks_long_rows(spark: SparkSession, d: str) -> DataFrame:
    """Few long rows, at the default capacity."""
    coo, m = B.supplier_part(spark, d), B.count(spark, d, "supplier")
    nz = coo.count()
    return ranges.capacity_blocks(entries.all_row_nnz(coo, m), m, ranges.default_capacity(nz, m))


@query
def error_norms(spark: SparkSession, d: str) -> DataFrame:
    y = _spmm(spark, d)
    other = y.withColumn("x", F.transform("x", lambda v: F.when((F.col("row") % 10 == 3) & (v > 0), v + F.col("row") % 4).otherwise(v)))
    return compare.error_norms(y, other)


@query
def align_results(spark: SparkSession, d: str) -> DataFrame:
    """Products of the orders' nonzero taxes and nonzero discounts: orders without one or the other lack a row there."""
    m, n = _sizes(spark, d)
    x = B.part_vectors(spark, d, 4)
    taxes, discounts = (product.spmm(entries.drop_zeros(coo), x, m, 4, n, complete=False) for coo in (B.order_part_tax(spark, d), B.order_part_discount(spark, d)))
    pairs = compare.align(taxes, discounts)
    return pairs.select("row", F.posexplode("pairs").alias("z", "p")).select("row", _long("z").alias("z"), _long("p.a").alias("a"), _long("p.b").alias("b"))


@query
def footprint(spark: SparkSession, d: str) -> DataFrame:
    coo, (m, n) = B.order_part(spark, d), _sizes(spark, d)
    _, directory = layouts.to_hll(coo, m)
    return report.footprint(coo, directory, m, n, 4)


@query
def padding_ratio(spark: SparkSession, d: str) -> DataFrame:
    coo, (m, _) = B.order_part(spark, d), _sizes(spark, d)
    _, directory = layouts.to_hll(coo, m)
    return report.padding_ratio(coo, directory, m)


@query
def flops(spark: SparkSession, d: str) -> DataFrame:
    return entries.adjusted_nz(B.order_part_tax(spark, d), symmetric=False).select(report.flops(F.col("nz"), 4).alias("flops"))


@query
def preview_top10(spark: SparkSession, d: str) -> DataFrame:
    top = layouts.preview(layouts.to_csr(B.order_part(spark, d), _sizes(spark, d)[0]), 10)
    return top.select("row", _long("slot").alias("slot"), "col", _long("val").alias("val"))


@query
def preview_dense(spark: SparkSession, d: str) -> DataFrame:
    return layouts.preview(_spmm(spark, d), 10).select("row", _long("z").alias("z"), _long("val").alias("val"))


@query
def reshape_long(spark: SparkSession, d: str) -> DataFrame:
    return _cells(B.embedding_vectors(spark, d))


@query
def reshape_wide(spark: SparkSession, d: str) -> DataFrame:
    """The positive elements; those left out become zeros again."""
    wide = entries.to_wide(entries.to_long(B.embedding_vectors(spark, d)).where("val > 0"), B.VECTOR)
    return _cells(wide)


@query
def row_major(spark: SparkSession, d: str) -> DataFrame:
    return _entry(entries.row_major(B.order_part(spark, d)))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return prefix.places(df, [], order, "ordinal")


@query
def row_major_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their place in the row-major order, as partitions follow each other and rows stand in them."""
    dealt = entries.row_major(B.order_part(spark, d)).withColumn("at", F.monotonically_increasing_id())
    return _numbered(dealt, ["at"]).select("ordinal", "row", "col", _long("val").alias("val"))


@query
def saved_lines(spark: SparkSession, d: str) -> DataFrame:
    """A saved result's lines, with their places in the file."""
    path = text.scratch(spark)
    text.save_result(_spmm(spark, d), path)
    return text.numbered_lines(spark, path).select(F.col("at").alias("ordinal"), F.col("value").alias("line"))


@query
def csr_dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """A dump's lines after its header, with their places."""
    m, n = _sizes(spark, d)
    path = text.scratch(spark)
    coo = B.order_part(spark, d)
    text.save_csr_dump(layouts.to_csr(coo, m), m, n, coo.count(), path)
    found = text.numbered_lines(spark, path).withColumnRenamed("at", "ordinal").where("ordinal > 0")
    t = F.split(F.regexp_replace("value", " +", " "), " ")
    return found.select("ordinal", _long(t[0]).alias("row"), _long(t[1]).alias("col"), _long(t[2].cast("double")).alias("val"))


@query
def random_multivector(spark: SparkSession, d: str) -> DataFrame:
    x = generate.random_multivector(spark, B.count(spark, d, "part"), 4, 11)
    return entries.to_long(x).select("row", _long("z").alias("z"), "val")


def _written(spark: SparkSession, coo: DataFrame, meta: M.MatrixMeta) -> str:
    """The 0-based entries as a 1-based file in a new folder."""
    path = text.scratch(spark)
    matrix_market.write_mm(coo.withColumns({"row": F.col("row") + 1, "col": F.col("col") + 1}), meta, path)
    return path


@query
def mm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    coo, _ = matrix_market.read_mm(spark, _written(spark, B.order_part_tax(spark, d), M.MatrixMeta(m=m, n=n)))
    return _entry(coo)


@query
def mm_header(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    return matrix_market.read_mm_header(spark, _written(spark, B.order_part(spark, d), M.MatrixMeta(m=m, n=n))).to_df(spark)


@query
def mm_symmetric_read(spark: SparkSession, d: str) -> DataFrame:
    size = max(100, B.extent(spark, d, "lineitem", "l_suppkey"))
    coo, _ = matrix_market.read_mm(spark, _written(spark, B.lower_triangle(spark, d), M.MatrixMeta(symmetry="symmetric", m=size, n=size)))
    return _entry(coo)


@query
def mm_pattern_read(spark: SparkSession, d: str) -> DataFrame:
    m = B.extent(spark, d, "events", "user_id")
    coo, _ = matrix_market.read_mm(spark, _written(spark, B.user_event(spark, d), M.MatrixMeta(field="pattern", m=m, n=B.VECTORS)))
    return _entry(coo)


@query
def mm_raw(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    coo, _ = matrix_market.read_mm_raw(spark, _written(spark, B.order_part_tax(spark, d), M.MatrixMeta(m=m, n=n)))
    return _entry(coo)


@query
def mm_unsymmetric(spark: SparkSession, d: str) -> DataFrame:
    size = max(100, B.extent(spark, d, "lineitem", "l_suppkey"))
    coo, _ = matrix_market.read_mm_unsymmetric(spark, _written(spark, B.lower_triangle(spark, d), M.MatrixMeta(symmetry="symmetric", m=size, n=size)))
    return _entry(coo)


@query
def mm_complex_raw(spark: SparkSession, d: str) -> DataFrame:
    """Quantities and taxes as real and imaginary parts."""
    m, n = _sizes(spark, d)
    path = text.scratch(spark)
    both = B.table(spark, d, "lineitem").select(_long("l_orderkey").alias("row") + 1, _long("l_partkey").alias("col"), F.col("l_quantity").alias("re"), F.round(F.col("l_tax") * 100).alias("im"))
    both = both.toDF("row", "col", "re", "im").withColumn("col", F.col("col") + 1)
    matrix_market.write_mm(both, M.MatrixMeta(field="complex", m=m, n=n), path)
    coo, _ = matrix_market.read_mm_raw(spark, path)
    return coo.select("row", "col", _long("re").alias("re"), _long("im").alias("im"))


@query
def mm_array_header(spark: SparkSession, d: str) -> DataFrame:
    """Header of the dense result's shape, which the entries and the vectors give."""
    path = text.scratch(spark)
    last, k = B.order_part(spark, d).agg(F.max("row")).first()[0], len(B.part_vectors(spark, d, 4).first()["x"])
    matrix_market.write_mm_array_header(spark, last + 1, k, path)
    return matrix_market.read_mm_header(spark, path).to_df(spark).drop("nz")


@query
def dense_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _sizes(spark, d)
    path = text.scratch(spark)
    text.save_result(_spmm(spark, d), path)
    return _cells(text.read_multivector(spark, path, m, 4))


@query
def csr_dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    path = text.scratch(spark)
    coo = B.order_part(spark, d)
    text.save_csr_dump(layouts.to_csr(coo, m), m, n, coo.count(), path)
    found, m, _, _ = text.read_csr_dump(spark, path)
    return _slots(layouts.to_csr(found, m))


@query
def ell_dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m, n = _sizes(spark, d)
    path = text.scratch(spark)
    coo = B.order_part(spark, d)
    text.save_ell_dump(layouts.to_ell(coo, m), m, n, coo.count(), entries.max_nnz(coo).first()[0], path)
    return _slots(text.read_ell_dump(spark, path)[0])


@query
def typecode_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each typecode that the orders' keys can stand for, with how many orders do, and whether it is valid and
    supported."""
    pick = lambda names, by: F.array(*[F.lit(n) for n in names])[(F.floor(F.col("o_orderkey") / by) % len(names)).cast("int")]
    codes = B.table(spark, d, "orders").select(F.lit("matrix").alias("object"), pick(M.FORMATS, 1).alias("format"), pick(M.FIELDS, 2).alias("field"), pick(M.SYMMETRIES, 8).alias("symmetry"))
    return codes.groupBy("object", "format", "field", "symmetry").agg(F.count(F.lit(1)).alias("orders")).select("*", M.valid_typecode().alias("valid"), M.supported().alias("supported"))
