"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed on in slices of about so many bytes, to bound a task's working memory.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share: that of spark.checkpoint.dir.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that later steps read only the columns that they use."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same with the table's folder, which discard() deletes once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def sample_texts(texts: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """At most `most` distinct rows (*by, text) of each group of `by`, or of all, chosen by a hash of the text.

    Ids play no part: rows without ids, repeated ids and repeated rows neither crowd the sample nor empty it. One pass estimates the
    number of distinct texts; only rows under the hash bound that follows are shuffled, and the window holds no more of them
    than about 1.3 * most for a group.
    """
    hashed = texts.where("text is not null").withColumn("_hash", F.xxhash64("text"))
    order = F.pmod(F.xxhash64("_hash", F.lit("sample")), F.lit(1 << 30))
    many = F.approx_count_distinct("_hash", 0.02).alias("_texts")
    bound = F.lit((1.2 * most + 8) * (1 << 30))
    if by:
        near = hashed.join(F.broadcast(hashed.groupBy(*by).agg(many)), by).where(order * F.col("_texts") < bound).dropDuplicates([*by, "_hash"])
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order, "_hash"))
        return near.withColumn("_place", place).where(F.col("_place") <= most).select(*by, "text")
    near = hashed.where(order * F.lit(hashed.agg(many).first()[0]) < bound).dropDuplicates(["_hash"])
    return near.orderBy(order, "_hash").limit(most).select("text")


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names (in any letter case) put under other names, and what gives them their names back
    and leaves the other columns of df alone in the result."""
    taken = {n.lower() for n in names}
    new = {c: f"_aside_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    moved = df.withColumnsRenamed(new) if new else df
    columns = df.columns
    return moved, lambda out: out.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in columns])


def binary(column: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 bytes of a string column with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes, one row at least."""
    if not batch.num_rows:
        return
    import numpy as np

    data = binary(batch.column(text_col))
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    start = 0
    while start < len(data):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def map_arrow(df: DataFrame, add: Callable[[pa.RecordBatch], dict | None], fields: list[T.StructField], text_col: str, keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Columns `keep` of df (all when None, less those named like a new one) and those that `add` makes of each slice of about
    `limit` bytes.

    add: takes a RecordBatch; returns a dict of name to Arrow array in the order of fields.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = [f.name for f in fields]
    rest = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name in rest] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, limit):
                made = add(part)
                cols = [part.column(c) for c in rest] + [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], k) for n, k in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=rest + new)

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(rest + [text_col])]).mapInArrow(run, T.StructType([schema[c] for c in rest] + fields))
