"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side that grows with the input, so that its join goes by shuffle and sort.

    Spark takes a table for as large as its compressed files, and an exploded one for as large as before, so it would broadcast
    millions of rows that it estimates under its threshold.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the folder that the cluster shares and read again, so that loops keep no lineage."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-graph-")
    path = f"{root}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
