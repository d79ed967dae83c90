"""Lines of text files with their order, dense multivectors, and dumps of row layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.functions.numbers import number, printf, printf_all
from sparloom.meta import MatrixFormatError
from sparloom.operators.prefix import COUNTS
from sparloom.shared import checkpoint
from sparloom.shared import scratch as scratch

#: Slots that a task sorts, writes or groups at most, about; where there are few, slots that are worth a task.
TASK_SLOTS, FEW_SLOTS = 1 << 19, 1 << 14


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file string, block long, line long): text lines; the last three, in this order, sort them as the files, by their
    paths, have them. Line numbers only grow inside a split, which is all that the order needs."""
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at long): text lines with their places, from 0, in the files as lines() orders them.

    A first scan counts the lines of each split; a line's place comes from its split's and its own number, so lines are neither shuffled
    nor sorted. Raises where files are split otherwise for the second scan.
    """
    every = lines(spark, path)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = every.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    splits = checkpoint(splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    splits = F.broadcast(splits) if splits.count() <= COUNTS else splits
    inside = F.col("line") - F.col("first")
    moved = F.raise_error(F.lit("the files were split otherwise while they were read")).cast("bigint")
    at = F.when(inside.between(F.lit(0), F.col("n") - 1), F.col("start") + inside).otherwise(moved)
    return every.join(splits, ["file", "block"], "left").select("value", at.alias("at"))


def tasks_for(spark: SparkSession, slots: int) -> int:
    """Tasks for so many slots of a layout: what one of them holds doesn't grow with the layout."""
    return max(1, -(-slots // TASK_SLOTS), min(spark.sparkContext.defaultParallelism, -(-slots // FEW_SLOTS)))


def tokens() -> Column:
    return F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")


def sequence() -> Column:
    return F.struct("file", "block", "line")


def head(spark: SparkSession, path: str, enough) -> list[str]:
    """The first lines of the first file, as many as `enough`, asked for a growing list of them, says."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    first = spark.read.text(files[0]).where(F.col("_metadata.file_block_start") == 0)
    n, got = 64, []
    while True:
        rows = [r["value"] for r in first.limit(n).collect()]
        if enough(rows) or len(rows) == len(got):
            return rows
        n, got = 4 * n, rows


def lines_in_order(body: DataFrame, order: list[str], line: Column, header: list[str]) -> DataFrame:
    """(line): the header's lines, then `line` of every row of body, sorted by `order`.

    The columns are sorted, and lines are made of them after that: a sort runs what comes before it twice, once for its ranges, and
    numbers are shorter than their text. Body should have the columns of order and line only.
    """
    body, by = _headed(body, order, header)
    return body.orderBy(*by).select((F.coalesce("_head", line) if header else line).alias("line"))


def _headed(body: DataFrame, order: list[str], header: list[str]) -> tuple[DataFrame, list[str]]:
    """body with a row for each line of the header, in `_head`, and the columns to sort both by."""
    body = body.select("*", F.lit(len(header)).alias("_part"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)])
    if header:
        first = body.sparkSession.createDataFrame([(h, i) for i, h in enumerate(header)], "_head string, _part int")
        body = first.unionByName(body, allowMissingColumns=True)
    return body, ["_part", *[f"_k{i}" for i in range(len(order))]]


def write_lines(body: DataFrame, order: list[str], path: str, line: Column, header: list[str] | None = None, mode: str = "errorifexists") -> None:
    """`line` of every row of body, sorted by `order` over all part files, after the header's lines. The parts, read by name, are the file."""
    _write(lines_in_order(body, order, line, header or []), path, mode)


def read_multivector(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """(row, x array of cols): number t of the file, whatever its line, is element (t div cols, t mod cols); numbers
    after the last element are ignored, missing ones raise.

    A first scan counts the numbers of each split of the file. Where every line has cols of them, as save_result() writes it, a line is a row,
    its place known from its split's; else lines are numbered in their split and cut at the borders of rows. Values are
    shuffled only for rows that lie in several lines.
    """
    numbers = F.filter(tokens(), lambda x: x != "")
    counted = lines(spark, path).withColumn("n", F.size(numbers).cast("long"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.groupBy("file", "block").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("line").alias("first"))
    splits = checkpoint(splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    stat = splits.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("splits")).first()
    if (stat["n"] or 0) < rows * cols:
        return spark.range(max(rows, 1)).select(F.col("id").alias("row"), F.raise_error(F.lit("the file has too few numbers")).cast("array<double>").alias("x"))
    splits = splits.select("file", "block", "first", "start")
    splits = F.broadcast(splits) if stat["splits"] <= COUNTS else splits
    parsed = lambda t: F.transform(t, lambda x: number(x, "double"))
    if stat["least"] == stat["most"] == cols:
        row = F.expr(f"start div {cols}") + F.col("line") - F.col("first")
        found = lines(spark, path).join(splits, ["file", "block"]).select(row.alias("row"), "value").where(F.col("row") < rows)
        return found.select("row", parsed(numbers).alias("x"))
    at = _inside(counted).join(splits, ["file", "block"]).select((F.col("start") + F.col("inside")).alias("at"), "n", numbers.alias("t")).where((F.col("n") > 0) & (F.col("at") < rows * cols))
    each = at.select("at", "t", F.explode(F.sequence(F.expr(f"at div {cols}"), F.least(F.expr(f"(at + n - 1) div {cols}"), F.lit(rows - 1)))).alias("row"))
    begin = F.greatest(F.col("row") * cols - F.col("at"), F.lit(0)).cast("int")
    z = F.greatest(F.col("at") - F.col("row") * cols, F.lit(0)).cast("int")
    pieces = each.select("row", z.alias("z"), F.slice("t", begin + 1, F.lit(cols) - z).alias("t"))
    whole = pieces.where(F.size("t") == cols).select("row", parsed("t").alias("x"))
    cut = pieces.where(F.size("t") < cols).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("z", "t"))).alias("p"))
    return whole.unionByName(cut.select("row", parsed(F.flatten(F.transform("p", lambda p: p["t"]))).alias("x")))


def _inside(counted: DataFrame) -> DataFrame:
    """counted with `inside`: the numbers before a line in its split. A split is read by one task, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, upto = None, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
            inside = np.zeros(len(n), np.int64)
            edges = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    upto = upto if at[a] == split else 0
                    split = at[a]
                    inside[a:b] = upto + np.cumsum(n[a:b]) - n[a:b]
                    upto += int(n[a:b].sum())
            yield batch.append_column("inside", pa.array(inside))

    kept = counted.select("value", "file", "block", "n")
    return kept.mapInArrow(run, "value string, file string, block long, n long, inside long")


def save_result(y: DataFrame, path: str, **how) -> None:
    """(row, x) as text: a line for each row with numbers, in order, each number as %.16g with a space after it."""
    write_lines(y.select("row", "x").where(F.size("x") > 0), ["row"], path, printf_all(F.col("x"), "%.16g "), **how)


def result_name(matrix_path: str, k: int) -> str:
    """Name of the result file of a matrix file: its extension of three letters gives way to the number of columns."""
    return f"{matrix_path[:-4]}_{k}.txt"


def _slot_line() -> Column:
    return F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), printf(F.col("val"), "%20.19g"))


def slot_lines(layout: DataFrame, slots: int, header: str) -> DataFrame:
    """(line): the header, then a line for each of the layout's slots, about `slots` in number, in order.

    Whole rows or segments are sorted, by ranges of about TASK_SLOTS slots, and cut into slots after that.
    """
    order = ["row", "first_slot"] if "first_slot" in layout.columns else ["row"]
    body, by = _headed(layout.select(*order, "ja", "vals"), order, [header])
    dealt = body.repartitionByRange(tasks_for(body.sparkSession, slots), *by).sortWithinPartitions(*by)
    flat = dealt.select("_head", "row", F.explode_outer(F.arrays_zip("ja", "vals")).alias("_e")).where("_head is not null or _e is not null")
    flat = flat.select("_head", "row", F.col("_e.ja").alias("col"), F.col("_e.vals").alias("val"))
    return flat.select(F.coalesce("_head", _slot_line()).alias("line"))


def save_csr_dump(csr: DataFrame, m: int, n: int, nz: int, path: str, **how) -> None:
    """Header `m n nz`, then 0-based `row col value` in row order."""
    _write(slot_lines(csr, nz, f"{m} {n} {nz}"), path, **how)


def save_ell_dump(ell: DataFrame, m: int, n: int, nz: int, maxnz: int, path: str, **how) -> None:
    """Header `m n nz maxnz`, then every slot of every row, padding (column and value 0) included."""
    _write(slot_lines(ell, m * maxnz, f"{m} {n} {nz} {maxnz}"), path, **how)


def _write(made: DataFrame, path: str, mode: str = "errorifexists") -> None:
    made.write.mode(mode).text(path)


def _dump(spark: SparkSession, path: str, fields: int) -> tuple[list[int], DataFrame]:
    """Header numbers, and (row, col, val, seq long) of the lines after it; seq: a line's place. A header has `fields` numbers; where it is as
    long as an entry, it is the first line of the first file that isn't blank."""
    rows = head(spark, path, lambda rows: any(r.strip() for r in rows))
    top = [r for r in rows if r.strip()]
    if not top:
        raise MatrixFormatError("the dump is empty")
    numbers = [int(x) for x in top[0].split()]
    if len(numbers) != fields:
        raise MatrixFormatError(f"a header of {fields} numbers is missing")
    body = numbered_lines(spark, path).where((F.trim("value") != "") & (F.col("at") > rows.index(top[0])))
    t = tokens()
    return numbers, body.select(number(t[0], "bigint").alias("row"), number(t[1], "bigint").alias("col"), number(t[2], "double").alias("val"), F.col("at").alias("seq"))


def read_csr_dump(spark: SparkSession, path: str) -> tuple[DataFrame, int, int, int]:
    """((row, col, val, seq), m, n, nz) of a dump; to_csr makes rows and pointers of it again, empty rows included."""
    (m, n, nz), entries = _dump(spark, path, 3)
    return entries, m, n, nz


def read_ell_dump(spark: SparkSession, path: str) -> tuple[DataFrame, int, int, int, int]:
    """((row, ja, vals), m, n, nz, maxnz) of a dump; a row's slots are in the order of its lines.

    Lines of a row that follow each other are one record before they are shuffled: arrays and the place of the first.
    """
    (m, n, nz, maxnz), entries = _dump(spark, path, 4)
    runs = _as_runs(entries).repartition(tasks_for(spark, m * maxnz), "row")
    items = F.sort_array(F.collect_list(F.struct("seq", "ja", "vals")))
    rows = runs.groupBy("row").agg(items.alias("_i"))
    return rows.select("row", *[F.flatten(F.transform("_i", lambda e: e[c])).alias(c) for c in ("ja", "vals")]), m, n, nz, maxnz


def _as_runs(entries: DataFrame) -> DataFrame:
    """Entries (row, col, val, seq) as runs (row, seq, ja, vals) of a row's lines without another line between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, seq = batch.column("row").to_numpy(), batch.column("seq").to_numpy()
            starts = np.concatenate([[0], 1 + np.flatnonzero((np.diff(row) != 0) | (np.diff(seq) != 1))])
            ends = pa.array(np.append(starts, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("col", "val")]
            yield pa.RecordBatch.from_arrays([pa.array(row[starts]), pa.array(seq[starts]), *lists], names=["row", "seq", "ja", "vals"])

    return entries.mapInArrow(run, "row long, seq long, ja array<bigint>, vals array<double>")
