"""File scans and sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.schema import RAW_COLUMNS


def read_incidents_csv(
    spark: SparkSession,
    path: str | list[str],
    required: Sequence[str] = RAW_COLUMNS,
    sep: str = ",",
    infer: bool = False,
) -> DataFrame:
    """Read CSV files with headers and keep the `required` columns by name.

    Files may order their columns differently and have further ones: the header of each file
    is read first, files of the same header are scanned together, and the scans are joined by
    name. A file without one of the required columns is an error. All columns are text
    unless `infer` asks Spark for one more pass over the data to find types.
    """
    scans = []
    for header, files in csv_headers(spark, path).items():
        present = {c.strip("\ufeff ").lower() for c in next(csv.reader([header], delimiter=sep))}
        missing = [c for c in required if c.lower() not in present]
        if missing:
            raise ValueError(f"columns not found in {files[0]} and {len(files) - 1} more: {missing}")
        df = (
            spark.read.format("csv")
            .option("header", True)
            .option("inferSchema", infer)
            .option("enforceSchema", False)
            .option("sep", sep)
            .load(files)
        )
        named = {c.strip("\ufeff ").lower(): c for c in df.columns}
        scans.append(df.select(*[F.col(f"`{named[c.lower()]}`").alias(c) for c in required]))
    if not scans:
        raise ValueError(f"no CSV file with a header in {path}")
    if infer:
        scans = _same_types(scans)
    return reduce(DataFrame.unionByName, scans)


def csv_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The distinct first lines of the files below `path`, each with its files.

    One pass over the lines without parsing them: the first line of the first block of every
    file stays. There are as many rows in the end as different headers.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    at_start = lines.filter("start = 0").withColumn("place", F.monotonically_increasing_id())
    first = at_start.groupBy("uri").agg(F.min_by("value", "place").alias("header"))
    # The metadata has the path as an address, in which only a plus stands for itself.
    file = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list(file)).alias("files"))
    return {r["header"]: r["files"] for r in found.orderBy("files").collect()}


def _same_types(scans: list[DataFrame]) -> list[DataFrame]:
    """The scans with one type per column: their own, double for numbers that differ, else text."""
    kinds = [dict(df.dtypes) for df in scans]
    numbers = {"int", "bigint", "double"}

    def common(c: str) -> str:
        own = {k[c] for k in kinds}
        return own.pop() if len(own) == 1 else "double" if own <= numbers else "string"

    return [df.select(*[F.col(f"`{c}`").cast(common(c)).alias(c) for c in df.columns]) for df in scans]


def first_rows(spark: SparkSession, path: str, n: int, at_once: int = 64) -> DataFrame:
    """The first `n` rows of the Parquet files below `path`, in the order of file names and rows.

    Files are counted from the first on, by their footers, until they hold `n` rows; the
    others are not opened. Within a file the place of a row is a column of the scan, so nothing
    is sorted.
    """
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    wanted: dict[str, int] = {}
    left = n
    for at in range(0, len(files), at_once):
        if left <= 0:
            break
        uri = F.col("_metadata.file_path").alias("uri")
        some = spark.read.schema(whole.schema).parquet(*map(unquote, files[at : at + at_once]))
        sizes = {r["uri"]: r["count"] for r in some.groupBy(uri).count().collect()}
        for name in sorted(sizes):
            if left > 0:
                wanted[name] = min(left, sizes[name])
                left -= sizes[name]
    if not wanted:
        return whole.limit(0)
    scan = spark.read.schema(whole.schema).parquet(*map(unquote, wanted))
    # Only the last file is cut.
    last, rows = list(wanted.items())[-1]
    return scan.filter((F.col("_metadata.file_path") != last) | (F.col("_metadata.row_index") < rows))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write a folder of CSV part files with headers, one per partition."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def take_first(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first `n` rows in the order of a key (files have no stable order)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def concat(*chunks: DataFrame) -> DataFrame:
    """Bag union of tables with the same columns, matched by name."""
    return reduce(DataFrame.unionByName, chunks)
