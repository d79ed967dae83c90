"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: a lost executor costs nothing, and row numbers stay. Spark
    deletes the files with the last plan that reads them, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write: under the shared checkpoint folder. It is deleted when the session's
    driver ends, unless discard() does so before."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.gettempdir()
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/matrix-{uuid.uuid4().hex}")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(top)
    files.deleteOnExit(top)
    return f"{top}/table"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getName() == "table":
        folder = folder.getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
