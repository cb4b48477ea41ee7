"""Cutting lineage: frames written once to the folder that all executors share, and read from there."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may go without one, and gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="remedex-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The frame checkpointed below the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a compressed table of its own below the shared folder; a checkpoint keeps rows uncompressed."""
    at, schema = new_folder(df.sparkSession), df.schema
    df.write.parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


@contextmanager
def tidy(spark: SparkSession):
    """Within the block Spark deletes the shuffle files of a query when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Steps:
    """Frames written on the way to a result. They are deleted when the block ends, so the result must be written by then.

    with Steps(spark) as steps:
        x = steps.put(df)
        return settled(result_of(x))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, new_folder(spark), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at, schema = f"{self.path}/{self.n}", df.schema
        df.write.parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
