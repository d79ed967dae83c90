"""The three standard runs: load a matrix file, lay it out, multiply, check against the plain product, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparloom.meta import MatrixMeta
from sparloom.operators.compare import error_norms
from sparloom.operators.entries import all_row_nnz
from sparloom.operators.layouts import SEGMENT, to_csr, to_ell, to_hll
from sparloom.operators.product import spmm, spmm_layout
from sparloom.operators.ranges import balanced_ranges, capacity_blocks, default_capacity, part_loads
from sparloom.operators.report import flops, footprint
from sparloom.sources.generate import random_multivector
from sparloom.sources.matrix_market import read_mm
from sparloom.sources.text import result_name, save_result


@dataclass
class Result:
    meta: MatrixMeta
    y: DataFrame
    errors: DataFrame
    loads: DataFrame
    sizes: DataFrame | None
    flops: int
    saved: str | None


def run(spark: SparkSession, path: str, k: int, layout: str = "csr", parts: int = 8, x: DataFrame | None = None, seed: int = 0, save: bool = False, balance: str = "quota") -> Result:
    """Multiply the file's matrix by x, a random multivector when None. layout: "csr", "ell" or "hll"; balance: rows split
    into `parts` ranges by "quota", or into blocks of the default "capacity". save: write Y beside the matrix file."""
    coo, meta = read_mm(spark, path)
    x = random_multivector(spark, meta.n, k, seed) if x is None else x
    sizes = None
    if layout == "hll":
        rows, directory = to_hll(coo, meta.m, segment=SEGMENT)
        sizes = footprint(coo, directory, meta.m, meta.n, k)
    elif layout in ("csr", "ell"):
        rows = to_ell(coo, meta.m) if layout == "ell" else to_csr(coo, meta.m, SEGMENT)
    else:
        raise ValueError(f"unknown layout {layout}")
    y = spmm_layout(rows, x, meta.m, k, meta.n)
    errors = error_norms(y, spmm(coo, x, meta.m, k, meta.n))
    nnz = all_row_nnz(coo, meta.m)
    if balance == "capacity":
        ranges = capacity_blocks(nnz, meta.m, default_capacity(meta.nz, meta.m)).withColumnRenamed("block", "part")
    else:
        ranges = balanced_ranges(nnz, meta.m, parts)
    saved = None
    if save:
        saved = result_name(path, k)
        save_result(y, saved)
    return Result(meta, y, errors, part_loads(nnz, ranges, meta.m), sizes, flops(meta.nz, k), saved)
