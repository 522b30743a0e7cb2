"""Counts and percentages of a flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import pct


def flag_count(df: DataFrame, key: str, flag: str, value: object = "true") -> DataFrame:
    """(key, n_flag): how often the flag has this value; other keys show 0."""
    return df.groupBy(key).agg(F.count_if(F.col(flag) == F.lit(value)).alias("n_flag"))


def flag_rate(df: DataFrame, key: str, flag: str, value: object = "true") -> DataFrame:
    """(key, n_flag, n, pct) in one aggregation."""
    return (
        df.groupBy(key)
        .agg(
            F.count_if(F.col(flag) == F.lit(value)).alias("n_flag"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("pct", pct("n_flag", "n"))
    )


def flag_pivot(
    df: DataFrame,
    key: str,
    flag: str,
    values: Sequence[str] = ("true", "false"),
    fill_zero: bool = False,
) -> DataFrame:
    """One row per key and one count column per flag value.

    A value that never occurs for a key is null, or 0 with `fill_zero`. The
    values are given, so no job runs to find them and one shuffle is enough.
    """

    def cell(v: str) -> Column:
        n = F.count_if(F.col(flag) == F.lit(v))
        return (n if fill_zero else F.nullif(n, F.lit(0))).alias(v)

    return df.groupBy(key).agg(*[cell(v) for v in values])


def flag_trend(
    df: DataFrame,
    key: str,
    flag: str,
    values: Sequence[str] = ("true", "false"),
    fill_zero: bool = False,
) -> DataFrame:
    """`flag_pivot` with the total and the percentage of the first value."""
    hit, *_ = values
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{hit}`"))
    return (
        flag_pivot(df, key, flag, values, fill_zero)
        .withColumn("total", total)
        .withColumn("pct", pct(F.col(f"`{hit}`"), F.col("total")))
        .orderBy(key)
    )


def outer_counts(
    df: DataFrame,
    group: str,
    flag: str,
    a: object = "true",
    b: object = "false",
    weight: str | None = None,
) -> DataFrame:
    """(group, n_a, n_b, pct_a) for every group that has either flag value.

    Same rows as an outer join of the two filtered counts with nulls set to 0,
    from one scan and one shuffle. With `weight`, rows are counts themselves.
    """
    size = F.lit(1).cast("long") if weight is None else F.col(weight)

    def total(value: object, name: str) -> Column:
        return F.sum(F.when(F.col(flag) == F.lit(value), size).otherwise(0)).alias(name)

    return (
        df.filter(F.col(flag).isin(a, b))
        .groupBy(group)
        .agg(total(a, "n_a"), total(b, "n_b"))
        .withColumn("pct_a", pct(F.col("n_a"), F.col("n_a") + F.col("n_b")))
    )
