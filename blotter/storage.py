"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Where it is unset, a temporary folder is used in local mode only: on a
    cluster such a folder would not be seen by the other machines.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="blotter-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and read it back from there.

    Used where an iterative fit would otherwise rescan its source on every
    pass; the copy survives the loss of executors.
    """
    folder = shared_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Stages:
    """Tables of which each is made from the one before, which is then no longer needed.

    They lie as Parquet below the shared folder; at most two of them are there at a time.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.path = spark, label, None

    def write(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.label)
        df.write.parquet(path)
        self.clear()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        if self.path is not None:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.path = None
