"""Matrix Market files: header, stored triplets, the cleaning loader, and writers.

A path may be a file or a folder of part files, whose names give their order; the header stands in the first.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparloom.functions.numbers import printf
from sparloom.meta import BANNER, FIELDS, FORMATS, OBJECTS, SYMMETRIES, MatrixFormatError, MatrixMeta, check_supported, is_valid_typecode
from sparloom.operators.entries import drop_zeros, mirror_symmetric, pattern_values, rebase
from sparloom.shared import discard, scratch
from sparloom.sources.text import head, lines, sequence, tokens, write_lines


def parse_banner(line: str) -> tuple[str, str, str, str]:
    """Object, format, field and symmetry of a file's first line."""
    words = line.split()
    if not words or not words[0].startswith(BANNER):
        raise MatrixFormatError("no header: the first line has no banner")
    if len(words) < 5:
        raise MatrixFormatError("premature end of the banner")
    kinds = [w.lower() for w in words[1:5]]
    for kind, known in zip(kinds, (OBJECTS, FORMATS, FIELDS, SYMMETRIES)):
        if kind not in known:
            raise MatrixFormatError(f"unsupported type: {kind}")
    return tuple(kinds)


def _is_entry(row: str) -> bool:
    return bool(row.strip()) and not row.startswith("%")


def read_mm_header(spark: SparkSession, path: str) -> MatrixMeta:
    """Typecode and sizes; comments and blank lines before the sizes are skipped. Reads the first lines only."""
    rows = head(spark, path, lambda rows: any(_is_entry(r) for r in rows))
    if not rows:
        raise MatrixFormatError("premature end of file")
    kinds = parse_banner(rows[0])
    sizes = next((r.split() for r in rows[1:] if _is_entry(r)), None)
    need = 2 if kinds[1] == "array" else 3
    if sizes is None or len(sizes) < need or not all(s.lstrip("-").isdigit() for s in sizes[:need]):
        raise MatrixFormatError("premature end of file: no sizes")
    m, n, *nz = map(int, sizes[:need])
    return MatrixMeta(*kinds, m=m, n=n, nz=nz[0] if nz else None)


def _loaded(spark: SparkSession, path: str, meta: MatrixMeta, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Stored triplets with their file order `seq`, checked to be meta.nz in number, and the sum of `counted` over all of them
    and the size line.

    The text is scanned once: its lines are parsed into a table in the shared folder, and the same scan finds the size line, which is the
    first line that isn't a comment, and counts the rest. Lines that aren't entries raise when they are read.
    """
    every = lines(spark, path).where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    fields = {"row": "bigint", "col": "bigint"} | ({"re": "double", "im": "double"} if meta.field == "complex" else {} if meta.field == "pattern" else {"val": "double"})
    t = tokens()
    parsed = {c: F.get(t, F.lit(i)).try_cast(kind) for i, (c, kind) in enumerate(fields.items())}
    token = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit("(missing)"))
    wrong = F.coalesce(*[F.when(parsed[c].isNull(), F.concat(F.lit(f"not a {kind}: "), token(i))) for i, (c, kind) in enumerate(fields.items())])
    seen = Observation()
    total = F.lit(0) if counted is None else F.coalesce(F.sum(counted), F.lit(0))
    rows = every.observe(seen, F.count(F.lit(1)).alias("n"), F.min(sequence()).alias("s"), total.cast("long").alias("total"))
    table = scratch(spark)
    rows.select(*[v.alias(c) for c, v in parsed.items()], wrong.alias("wrong"), "file", "block", "line").write.parquet(table)
    stat = seen.get
    if stat["n"] - 1 != meta.nz:
        discard(spark, table)
        raise MatrixFormatError(f"premature end of file: {stat['n'] - 1} entries instead of {meta.nz}" if stat["n"] - 1 < meta.nz else f"{stat['n'] - 1} entries instead of {meta.nz}")
    s = stat["s"]
    schema = ", ".join([*[f"{c} {kind}" for c, kind in fields.items()], "wrong string, file string, block long, line long"])
    body = spark.read.schema(schema).parquet(table).where(~((F.col("file") == s["file"]) & (F.col("block") == s["block"]) & (F.col("line") == s["line"])))
    checked = {c: F.when(F.col("wrong").isNull(), F.col(c)).otherwise(F.raise_error(F.col("wrong")).cast(kind)) for c, kind in fields.items()}
    return body.select(*[v.alias(c) for c, v in checked.items()], sequence().alias("seq")), stat["total"]


def read_mm_raw(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """Stored triplets as they stand, 1-based, with their file order `seq`: row, col and val (real), re and im (complex)
    or neither (pattern)."""
    meta = read_mm_header(spark, path)
    if meta.format != "coordinate" or not is_valid_typecode(meta):
        raise MatrixFormatError(f"can't read entries of {meta.typecode()}")
    if meta.field == "integer":
        raise MatrixFormatError("unsupported type: integer entries are read by read_mm")
    return _loaded(spark, path, meta)[0], meta


def read_mm_unsymmetric(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """0-based stored triplets of a real file, whatever its symmetry."""
    meta = read_mm_header(spark, path)
    if meta.field != "real" or meta.format != "coordinate":
        raise MatrixFormatError(f"only real coordinate files are read here, not {meta.typecode()}")
    return rebase(_loaded(spark, path, meta)[0]), meta


def read_mm(spark: SparkSession, path: str, dtype: str = "double") -> tuple[DataFrame, MatrixMeta]:
    """(entries, meta): 0-based (row, col, val, seq), patterns as ones, explicit zeros dropped, symmetric halves mirrored;
    meta.nz counts these. dtype "float" rounds values to single precision. Skew-symmetric files give their stored half."""
    meta = read_mm_header(spark, path)
    check_supported(meta)
    if not is_valid_typecode(meta):
        raise MatrixFormatError(f"invalid typecode {meta.typecode()}")
    if meta.symmetry in ("skew-symmetric", "hermitian"):
        warnings.warn(f"{meta.typecode()}: the stored half is read as it stands, the other half isn't made", stacklevel=2)
    symmetric, pattern, kind = meta.symmetry == "symmetric", meta.field == "pattern", "float" if dtype == "float" else "double"
    # How many entries a stored one makes: none for a zero, two off the diagonal of a symmetric matrix. Lines that aren't
    # entries raise when they are read below.
    t = tokens()
    kept = F.lit(1) if pattern else F.coalesce((F.get(t, F.lit(2)).try_cast(kind) != 0).cast("int"), F.lit(0))
    at = [F.get(t, F.lit(i)).try_cast("bigint") for i in (0, 1)]
    twice = F.coalesce((at[0] != at[1]).cast("int"), F.lit(0)) if symmetric else F.lit(0)
    rows, total = _loaded(spark, path, meta, kept * (1 + twice))
    size_line = (1 if pattern else int(meta.nz != 0)) * (1 + int(symmetric and meta.m != meta.n))
    coo = rebase(rows)
    coo = pattern_values(coo) if pattern else drop_zeros(coo.withColumn("val", F.col("val").cast(kind).cast("double")))
    coo = coo.select("row", "col", "val", "seq")
    return mirror_symmetric(coo) if symmetric else coo, meta.with_nz(total - size_line)


def write_mm(coo: DataFrame, meta: MatrixMeta, path: str, order: list[str] | None = None, **how) -> None:
    """Coordinate file of entries as they stand (1-based ones, to be read again), sorted by `order`, by row and column if
    not given; header and sizes first. One pass counts the entries where meta.nz isn't known."""
    if meta.field == "integer":
        raise MatrixFormatError("unsupported type: integer entries aren't written")
    values = ["re", "im"] if meta.field == "complex" else [] if meta.field == "pattern" else ["val"]
    line = F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), *[printf(F.col(v), "%20.16g") for v in values])
    nz = coo.count() if meta.nz is None else meta.nz
    order = order or (["seq"] if "seq" in coo.columns else ["row", "col"])
    header = [f"{BANNER} {meta.typecode()}", f"{meta.m} {meta.n} {nz}"]
    write_lines(coo.select(*dict.fromkeys(["row", "col", *values, *order])), order, path, line, header=header, **how)


def write_mm_array_header(spark: SparkSession, m: int, n: int, path: str, field: str = "real", symmetry: str = "general", **how) -> None:
    """Banner and sizes of a dense file."""
    write_lines(spark.range(0), ["id"], path, F.lit(""), header=[f"{BANNER} matrix array {field} {symmetry}", f"{m} {n}"], **how)
