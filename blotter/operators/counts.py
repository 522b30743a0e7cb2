"""Row counts, distinct values, frequency tables and their top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import pct


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns))
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values; a null counts as one value.

    Values are made unique on the map side and again after a shuffle on the
    value itself, so no task sees them all.
    """
    if approximate:
        has_null = F.max(F.col(column).isNull().cast("int"))
        return df.agg(
            (F.approx_count_distinct(column) + F.coalesce(has_null, F.lit(0)))
            .cast("long")
            .alias("n_distinct")
        )
    return distinct_values(df, column).agg(F.count(F.lit(1)).alias("n_distinct"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n). Partial counts are made before the shuffle, so a hot key
    costs one row per map task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, key: str, n: int, ascending_output: bool = False) -> DataFrame:
    """The `n` most frequent values; equal counts are ordered by value."""
    top = count_by(df, key).orderBy(F.desc("n"), F.asc(key)).limit(n)
    return top.orderBy(F.asc("n"), F.desc(key)) if ascending_output else top


def column_totals(cells: DataFrame, column: str, value: str = "n") -> DataFrame:
    """Totals per column of a long count matrix."""
    return cells.groupBy(column).agg(F.sum(value).alias(value))


def share_of_total(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, n, pct): count (or sum of `weight`) per key and its share of all.

    The total is one number, brought in as a scalar subquery.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    total = df.agg(size.alias("total")).scalar()
    return (
        df.groupBy(key)
        .agg(size.alias("n"))
        .withColumn("pct", pct(F.col("n"), total))
    )


def count_vs_mean(df: DataFrame, key: str) -> DataFrame:
    """(key, n, mean_n): count per key next to the mean over all keys."""
    counts = count_by(df, key)
    mean = counts.agg(F.avg("n").alias("mean_n")).scalar()
    return counts.withColumn("mean_n", mean)
