"""Row layouts: compressed rows, rows padded to the longest one, and rows padded by groups ("hacks")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.numbers import ceil_div, round_up
from sparloom.operators.entries import all_row_nnz, complete_rows, max_nnz, row_nnz, to_long
from sparloom.operators.prefix import hack_offsets, places, row_pointers

#: Padded slots per entry beyond which the globally padded layout is refused.
ELL_LIMIT = 64
#: Padding slots that are generated together.
PADDING = 1024
#: Entries of a segment of a row at most, unless another number is asked for.
SEGMENT = 1 << 16


class PaddingError(ValueError):
    """The padded layout would be far larger than the matrix; pad by groups of rows instead."""


def grouped_rows(coo: DataFrame, m: int) -> DataFrame:
    """(row, ja, vals) of rows 0 to m - 1, entries in file order (`seq`) or else by column and value. One shuffle by row."""
    order = ["seq", "col", "val"] if "seq" in coo.columns else ["col", "val"]
    items = F.sort_array(F.collect_list(F.struct(*order)))
    rows = coo.groupBy("row").agg(items.alias("_items"))
    rows = rows.select("row", F.transform("_items", lambda e: e["col"]).alias("ja"), F.transform("_items", lambda e: e["val"].cast("double")).alias("vals"))
    return complete_rows(rows, m, {"ja": F.array().cast("array<bigint>"), "vals": F.array().cast("array<double>")})


def _order(coo: DataFrame) -> list[str]:
    return ["seq"] if "seq" in coo.columns else ["col", "val"]


def slots(coo: DataFrame) -> DataFrame:
    """coo with `slot` long: an entry's place in its row, from 0. Numbered in two levels, so no task sees a whole long row."""
    return places(coo, ["row"], _order(coo), "slot")


def to_csr(coo: DataFrame, m: int, segment: int | None = None) -> DataFrame:
    """(row, irp, nnz int, ja, vals) of every row, each row one record. Pointers come from the rows themselves, whose shuffle Spark
    uses again.

    segment: cut rows into segments of so many entries at most, (row, first_slot, irp, nnz long, ja, vals), where nnz is that of the row;
    see segment_rows(). Whole rows as arrays are for rows that one task can hold.
    """
    if segment:
        placed = _placed(coo)
        counts = complete_rows(_counts(placed), m, {"nnz": F.lit(0).cast("long")})
        empty = row_pointers(counts, m).join(counts.where("nnz = 0").select("row"), "row", "left_semi")
        none = empty.withColumns({c: v for c, v in _empty().items() if c != "irp"})
        return _cut(placed, segment).unionByName(none).select("row", "first_slot", "irp", "nnz", "ja", "vals")
    rows = grouped_rows(coo, m)
    pointers = row_pointers(rows.select("row", F.size("ja").cast("long").alias("nnz")), m)
    return rows.join(pointers, "row").select("row", "irp", F.size("ja").alias("nnz"), "ja", "vals")


def _empty() -> dict[str, Column]:
    """What a row without entries has in a segment."""
    return {"first_slot": F.lit(0).cast("long"), "nnz": F.lit(0).cast("long"), "ja": F.array().cast("array<bigint>"), "vals": F.array().cast("array<double>")}


def _placed(coo: DataFrame) -> DataFrame:
    """Entries with their slot, their row's nnz, and where their row begins among all entries."""
    named = coo.select("row", "col", F.col("val").cast("double").alias("val"), *(["seq"] if "seq" in coo.columns else []))
    found = places(named, ["row"], _order(coo), "slot", "nnz", "at")
    return found.select("row", "col", "val", "slot", "nnz", (F.col("at") - F.col("slot")).alias("irp"))


def _counts(placed: DataFrame) -> DataFrame:
    """(row, nnz) of the rows with entries: each has one entry in slot 0."""
    return placed.where("slot = 0").select("row", "nnz")


def _cut(placed: DataFrame, segment: int) -> DataFrame:
    """(row, first_slot, irp, nnz, ja, vals) of rows with entries: one record for every `segment` slots."""
    items = F.sort_array(F.collect_list(F.struct("slot", "col", "val")))
    rows = placed.groupBy("row", F.expr(f"slot div {segment}").alias("_segment")).agg(items.alias("_items"), F.first("nnz").alias("nnz"), F.first("irp").alias("irp"))
    return rows.select("row", (F.col("_segment") * segment).alias("first_slot"), "irp", "nnz", F.transform("_items", lambda e: e["col"]).alias("ja"), F.transform("_items", lambda e: e["val"]).alias("vals"))


def segment_rows(coo: DataFrame, m: int, segment: int = SEGMENT) -> DataFrame:
    """(row, first_slot, nnz, ja, vals): rows cut into segments of `segment` entries, the last one maybe shorter, in file order (`seq`) or else
    by column and value; first_slot is the place of a segment's first entry in its row, nnz the row's entries. A row without
    entries is one empty segment.

    No record has more than `segment` entries, and segments are dealt by row and place, so a row may have any share of the
    entries. to_slots(), from_layout(), preview(), products and dumps take segments as they take whole rows.
    """
    placed = _placed(coo)
    empty = coo.sparkSession.range(m).select(F.col("id").alias("row")).join(_counts(placed).select("row"), "row", "left_anti")
    return _cut(placed, segment).drop("irp").unionByName(empty.withColumns(_empty())).select("row", "first_slot", "nnz", "ja", "vals")


def _pad(rows: DataFrame, width) -> DataFrame:
    missing = F.greatest(width - F.size("ja"), F.lit(0)).cast("int")
    return rows.withColumns({
        "ja": F.concat("ja", F.array_repeat(F.lit(0).cast("long"), missing)),
        "vals": F.concat("vals", F.array_repeat(F.lit(0.0), missing)),
    })


def to_ell(coo: DataFrame, m: int, limit: float = ELL_LIMIT) -> DataFrame:
    """(row, ja, vals) of every row, padded with column 0 and value 0 to the longest one.

    Raises PaddingError where slots would exceed `limit` for each entry, as one long row among many short ones does;
    ell_slot_rows() gives the slots of any matrix.
    """
    stat = row_nnz(coo).agg(F.coalesce(F.max("nnz"), F.lit(0)), F.coalesce(F.sum("nnz"), F.lit(0))).first()
    width, nz = stat[0], stat[1]
    if nz and width * m > limit * nz:
        raise PaddingError(f"{m} rows of {width} slots for {nz} entries; use to_hll")
    return _pad(grouped_rows(coo, m), F.lit(width))


def ell_slot_rows(coo: DataFrame, m: int) -> DataFrame:
    """(row, slot, col, val): every slot of the layout padded to the longest row, one a record, however uneven the rows are.

    No row is ever one array: slots are numbered in two levels, and a row's padding is generated by runs of PADDING slots.
    """
    width = max_nnz(coo).first()[0]
    entries = slots(coo).select("row", F.col("slot").cast("int").alias("slot"), "col", F.col("val").cast("double").alias("val"))
    short = all_row_nnz(coo, m).where(F.col("nnz") < width)
    runs = short.select("row", F.explode(F.sequence(F.col("nnz"), F.lit(width - 1).cast("long"), F.lit(PADDING).cast("long"))).alias("_from"))
    padding = runs.select("row", F.explode(F.sequence(F.col("_from").cast("int"), (F.least(F.col("_from") + PADDING, F.lit(width)) - 1).cast("int"))).alias("slot"), F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("val"))
    return entries.unionByName(padding)


def hack_rows(m: int, maxnz: int) -> int:
    """Default rows of a hack: by the least power of two of the longest row's entries, 32 at most, as lanes of a row."""
    lanes = 1
    while lanes < min(maxnz, 32):
        lanes *= 2
    return min(round_up(max(m, 1), 32 // lanes), 1024 // lanes)


def hack_directory(coo: DataFrame, m: int, rows_per_hack: int) -> DataFrame:
    """(hack, first_row, n_rows, maxnz, hack_offset) of every hack; maxnz is 0 where all rows are empty."""
    return _directory(row_nnz(coo), m, rows_per_hack)


def _directory(nnz: DataFrame, m: int, rows_per_hack: int) -> DataFrame:
    hacks = ceil_div(m, rows_per_hack)
    longest = nnz.groupBy(_hack(rows_per_hack).alias("hack")).agg(F.max("nnz").alias("maxnz"))
    every = nnz.sparkSession.range(hacks).select(F.col("id").alias("hack")).join(longest, "hack", "left")
    first = F.col("hack") * rows_per_hack
    directory = every.select("hack", first.alias("first_row"), F.least(F.lit(m) - first, F.lit(rows_per_hack)).cast("long").alias("n_rows"), F.coalesce("maxnz", F.lit(0)).alias("maxnz"))
    return directory.join(hack_offsets(directory, hacks), "hack")


def _hack(rows_per_hack: int) -> Column:
    return F.floor(F.col("row") / rows_per_hack).cast("long")


def to_hll(coo: DataFrame, m: int, rows_per_hack: int | None = None, segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((hack, row, ja, vals), directory): rows padded to the longest one of their hack, without the globally padded form.

    segment: cut the padded rows into segments of so many slots at most, (hack, row, first_slot, ja, vals); see segment_rows().
    """
    if segment:
        placed = _placed(coo)
        counts = _counts(placed)
        if rows_per_hack is None:
            rows_per_hack = hack_rows(m, counts.agg(F.coalesce(F.max("nnz"), F.lit(0))).first()[0])
        directory = _directory(counts, m, rows_per_hack)
        last = F.greatest(F.expr(f"(maxnz - 1) div {segment}"), F.lit(0))
        rows = coo.sparkSession.range(m).select(F.col("id").alias("row"), F.floor(F.col("id") / rows_per_hack).cast("long").alias("hack")).join(directory.select("hack", "maxnz"), "hack")
        every = rows.select("hack", "row", "maxnz", F.explode(F.sequence(F.lit(0).cast("long"), last * segment, F.lit(segment).cast("long"))).alias("first_slot"))
        cut = every.join(_cut(placed, segment).drop("nnz", "irp"), ["row", "first_slot"], "left")
        cut = cut.withColumns({c: F.coalesce(c, _empty()[c]) for c in ("ja", "vals")})
        return _pad(cut, F.least(F.col("maxnz") - F.col("first_slot"), F.lit(segment))).select("hack", "row", "first_slot", "ja", "vals"), directory
    if rows_per_hack is None:
        rows_per_hack = hack_rows(m, max_nnz(coo).first()[0])
    directory = hack_directory(coo, m, rows_per_hack)
    rows = grouped_rows(coo, m).withColumn("hack", _hack(rows_per_hack))
    padded = _pad(rows.join(directory.select("hack", "maxnz"), "hack"), F.col("maxnz"))
    return padded.select("hack", "row", "ja", "vals"), directory


def to_slots(layout: DataFrame) -> DataFrame:
    """(row, slot, col, val) of every slot of a layout, of whole rows or of segments, padding included."""
    first = ["first_slot"] if "first_slot" in layout.columns else []
    flat = layout.select("row", *first, F.posexplode(F.arrays_zip("ja", "vals")).alias("slot", "_e"))
    slot = F.col("first_slot") + F.col("slot") if first else F.col("slot")
    return flat.select("row", slot.alias("slot"), F.col("_e.ja").alias("col"), F.col("_e.vals").alias("val"))


def from_layout(layout: DataFrame) -> DataFrame:
    """(row, col, val) of the entries of any of the layouts; padding, and any other zero, is left out."""
    return to_slots(layout).where("val <> 0").select("row", "col", "val")


def preview(layout: DataFrame, n: int = 10) -> DataFrame:
    """The first n slots of a layout, or elements (row, z, val) of a dense multivector, in storage order; a top-n, not a sort of all."""
    if "x" in layout.columns:
        return to_long(layout).orderBy("row", "z").limit(n)
    return to_slots(layout).orderBy("row", "slot").limit(n)
