"""Views, saved tables and caching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def register(df: DataFrame, name: str) -> DataFrame:
    """Make `df` visible to SQL under `name` for this session."""
    df.createOrReplaceTempView(name)
    return df


def scan_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM `{name}`")


def save_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Save as a Parquet table; with `partition_by`, filters on it prune files."""
    writer = df.write.format("parquet").mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def keep_cached(df: DataFrame) -> DataFrame:
    """Cache a table that several reports read; blocks that do not fit go to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
