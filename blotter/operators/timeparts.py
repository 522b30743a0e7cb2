"""Parts of a timestamp and counts per calendar unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weekday names in calendar order; number 0 is Monday.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "weekday": F.weekday,
    "date": F.to_date,
    "time": lambda c: F.date_format(c, "HH:mm:ss"),
    "weekday_name": lambda c: F.date_format(c, "EEEE"),
}


def part(name: str, ts: str) -> Column:
    return PARTS[name](F.col(ts)).alias(name)


def time_parts(df: DataFrame, ts: str, *names: str) -> DataFrame:
    """Add the named parts (all of them by default) of the timestamp `ts`."""
    return df.withColumns({n: part(n, ts) for n in (names or PARTS)})


def count_by_part(df: DataFrame, ts: str, name: str) -> DataFrame:
    """(part, n) for one part of the timestamp, rows without one left out."""
    return (
        df.select(part(name, ts))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_by_weekday(df: DataFrame, ts: str) -> DataFrame:
    return count_by_part(df, ts, "weekday")


def count_by_month(df: DataFrame, ts: str) -> DataFrame:
    return count_by_part(df, ts, "month")


def monthly_counts(df: DataFrame, ts: str, fill: bool = True) -> DataFrame:
    """(month, n) along the calendar; months without rows count 0 with `fill`.

    The gaps are filled from the counted months alone: each month stretches to
    the one before the next. That window holds one row per calendar month, so
    its size does not grow with the number of incidents.
    """
    month = F.trunc(F.col(ts), "month")
    counts = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not fill:
        return counts
    following = F.lead("month").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    last = F.coalesce(F.add_months("_next", -1), F.col("month"))
    stretch = F.sequence("month", last, F.expr("INTERVAL 1 MONTH"))
    return (
        counts.withColumn("_next", following)
        .select("month", "n", F.explode(stretch).alias("_at"))
        .select(
            F.col("_at").alias("month"),
            F.when(F.col("_at") == F.col("month"), F.col("n"))
            .otherwise(F.lit(0))
            .alias("n"),
        )
    )
