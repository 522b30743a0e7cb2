"""Count matrices in long form, their wide view, and normalisations.

The canonical result is long: (row_key, col_key, n). A dense matrix (absent
cells present as 0) always has a column set of known size: hours, weekdays or
the top k of a ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blotter.functions import finite_or_zero
from blotter.operators.counts import count_by
from blotter.operators.timeparts import WEEKDAYS, part

HOURS = list(range(24))
WEEKDAY_NUMBERS = list(range(7))


def _keyed(df: DataFrame, row: Column | str, col: Column | str) -> DataFrame:
    as_column = [F.col(c) if isinstance(c, str) else c for c in (row, col)]
    keyed = df.select(as_column[0].alias("row_key"), as_column[1].alias("col_key"))
    return keyed.filter(F.col("row_key").isNotNull() & F.col("col_key").isNotNull())


def crosstab(df: DataFrame, row: Column | str, col: Column | str) -> DataFrame:
    """Sparse long counts of two keys; rows with a missing key are left out."""
    return count_by(_keyed(df, row, col), "row_key", "col_key")


def crosstab_wide(
    df: DataFrame,
    row: Column | str,
    col: Column | str,
    values: Sequence[object],
    prefix: str = "c_",
) -> DataFrame:
    """One row per row key and one count column per given column value.

    One aggregation with a counter per value: a row key leaves each map task
    as one row, and absent cells are 0 without a fill step.
    """
    cells = [F.count_if(F.col("col_key") == F.lit(v)).alias(f"{prefix}{v}") for v in values]
    return _keyed(df, row, col).groupBy("row_key").agg(*cells)


def crosstab_dense(
    df: DataFrame, row: Column | str, col: Column | str, values: Sequence[object]
) -> DataFrame:
    """Long counts with every given column value present for every row key."""
    wide = crosstab_wide(df, row, col, values)
    return melt(wide, values)


def melt(wide: DataFrame, values: Sequence[object], prefix: str = "c_") -> DataFrame:
    """The wide view back to long form, without a shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("col_key"), F.col(f"`{prefix}{v}`").alias("n"))
            for v in values
        ]
    )
    return wide.select("row_key", F.inline(cells))


def transpose(cells: DataFrame) -> DataFrame:
    """Swap rows and columns of a long matrix; only names change."""
    rest = [c for c in cells.columns if c not in ("row_key", "col_key")]
    return cells.select(
        F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), *rest
    )


def hour_by(df: DataFrame, ts: str, key: str, dense: bool = True) -> DataFrame:
    """key x hour of day."""
    if dense:
        return crosstab_dense(df, key, part("hour", ts), HOURS)
    return crosstab(df, key, part("hour", ts))


def weekday_by(df: DataFrame, ts: str, key: str, dense: bool = True) -> DataFrame:
    """key x weekday number."""
    if dense:
        return crosstab_dense(df, key, part("weekday", ts), WEEKDAY_NUMBERS)
    return crosstab(df, key, part("weekday", ts))


def weekday_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """weekday name x hour of day, with the weekday number to order by."""
    cells = crosstab_dense(df, part("weekday", ts), part("hour", ts), HOURS)
    name = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("row_key") + 1)
    return cells.select(F.col("row_key").alias("weekday"), name.alias("row_key"), "col_key", "n")


def daily_counts(df: DataFrame, ts: str, key: str) -> DataFrame:
    """calendar day x key, sparse."""
    return crosstab(df, part("date", ts), key)


def on_all_days(daily: DataFrame) -> DataFrame:
    """Give every column key a row on each day that occurs in the table, 0 if absent.

    The list of days is bounded by the calendar, so it travels as one array in
    a scalar subquery. The filters hold for every row; they make both uses ask
    for the counts, so that Spark counts once and reuses that shuffle.
    """
    counted = daily.filter(F.col("n") > 0)
    days = counted.agg(F.sort_array(F.collect_set("row_key")).alias("days")).scalar()
    grid = (
        counted.select("col_key").distinct().select("col_key", F.explode(days).alias("row_key"))
    )
    return grid.join(daily, ["row_key", "col_key"], "left").fillna(0, ["n"])


def rolling_sum(
    df: DataFrame,
    order: str,
    value: str,
    n: int,
    partition: Sequence[str],
    min_periods: int | None = None,
) -> DataFrame:
    """Add `rolling`: the sum over the last `n` rows, null before `min_periods` rows.

    Apply it to counts per day: then a partition is bounded by the calendar.
    """
    frame = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - n, 0)
    enough = F.count(value).over(frame) >= (n if min_periods is None else min_periods)
    return df.withColumn("rolling", F.when(enough, F.sum(value).over(frame)))


def rolling_runs(daily: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """(runs, calendar): stretches of days over which a key's rolling total stays the same.

    `daily` is a sparse matrix (row_key: a day or anything ordered, col_key, n). The calendar
    (row_key, at) numbers the days that occur from 0. A count enters the total of its key on its
    own day and leaves it `days` days later, so a key has at most two events per count,
    and `runs` (col_key, first, last, n, rolling) one row per event day, `n` being the count on
    the first day. No row is made for a day on which nothing changes.
    """
    counted = daily.filter(F.col("n") > 0)
    # One row per day: bounded by the calendar.
    dates = counted.select("row_key").distinct()
    numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("row_key")) - 1
    calendar = dates.withColumn("at", numbered)
    last = calendar.agg(F.max("at").alias("last")).scalar()
    n = F.col("n")
    events = counted.join(calendar, "row_key").select(
        "col_key",
        F.inline(
            F.array(
                F.struct(F.col("at").alias("first"), n.alias("n"), n.alias("_change")),
                F.struct((F.col("at") + days).alias("first"), (n * 0).alias("n"), (-n).alias("_change")),
            )
        ),
    )
    # Every key starts at 0 on the first day.
    starts = counted.select("col_key").distinct().select(
        "col_key", F.lit(0).alias("first"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("_change")
    )
    changes = (
        events.unionByName(starts)
        .filter(F.col("first") <= last)
        .groupBy("col_key", "first")
        .agg(F.sum("n").alias("n"), F.sum("_change").alias("_change"))
    )
    along = Window.partitionBy("col_key").orderBy("first")
    runs = changes.select(
        "col_key",
        "first",
        (F.coalesce(F.lead("first").over(along), last + 1) - 1).alias("last"),
        "n",
        F.sum("_change").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(
            "rolling"
        ),
    )
    return runs, calendar


def rolling_on_all_days(daily: DataFrame, days: int) -> DataFrame:
    """(row_key, col_key, n, rolling) for every day that occurs and every key.

    The totals come from `rolling_runs`; only this report spreads them over the days. They are
    null before `days` days have passed.
    """
    runs, calendar = rolling_runs(daily, days)
    each = runs.select("*", F.explode(F.sequence("first", "last")).alias("at"))
    return each.join(calendar, "at").select(
        "row_key",
        "col_key",
        F.when(F.col("at") == F.col("first"), F.col("n")).otherwise(0).alias("n"),
        F.when(F.col("at") >= days - 1, F.col("rolling")).alias("rolling"),
    )


def zscore_within(cells: DataFrame, row: str = "row_key", value: str = "n") -> DataFrame:
    """Add `z`: (value - mean of its row) / standard deviation of its row.

    For dense matrices: a row has one value per column of a known list, and it
    is already in one partition after `crosstab_dense`.
    """
    over = Window.partitionBy(row)
    z = F.try_divide(
        F.col(value) - F.avg(value).over(over), F.stddev_samp(value).over(over)
    )
    return cells.withColumn("z", z)


def minmax_within(cells: DataFrame, column: str = "col_key", value: str = "n") -> DataFrame:
    """Add `scaled`: the values of each column moved to 0..1, 0 where all are equal.

    The range of a column comes from an aggregation and is joined back, so a
    column with very many rows is never gathered in one task.
    """
    ranges = cells.groupBy(column).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return (
        cells.join(ranges, column)
        .withColumn("scaled", finite_or_zero(scaled))
        .drop("_lo", "_hi")
    )


def clip_symmetric(cells: DataFrame, value: str = "z") -> DataFrame:
    """Cut values to +-cap, where cap is the smaller of max and |min| of the matrix."""
    cap = cells.agg(F.least(F.max(value), F.abs(F.min(value))).alias("cap")).scalar()
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), cap), -cap))
    return cells.withColumn(value, clipped)


def top_columns_matrix(df: DataFrame, row: str, col: str, k: int = 10) -> DataFrame:
    """(row_key, col_key, n, scaled) for the `k` most frequent columns.

    Every row has all `k` columns; `scaled` moves a row's values to 0..1.
    The ranking has at most `k` rows, which is what is broadcast.
    """
    cells = crosstab(df, row, col)
    top = (
        cells.groupBy("col_key")
        .agg(F.sum("n").alias("_total"))
        .orderBy(F.desc("_total"), F.asc("col_key"))
        .limit(k)
        .select(F.col("col_key").alias("_top"))
    )
    names = top.agg(F.sort_array(F.collect_list("_top")).alias("names")).scalar()
    in_top = F.col("col_key") == F.col("_top")
    found = F.collect_list(F.when(in_top, F.struct("col_key", "n")))
    rows = (
        cells.join(F.broadcast(top), in_top, "left")
        .groupBy("row_key")
        .agg(F.map_from_entries(found).alias("_found"))
        .select("row_key", F.explode(names).alias("col_key"), "_found")
        .select(
            "row_key",
            "col_key",
            F.coalesce(F.try_element_at("_found", F.col("col_key")), F.lit(0)).alias("n"),
        )
    )
    over = Window.partitionBy("row_key")
    lo, hi = F.min("n").over(over), F.max("n").over(over)
    return rows.withColumn("scaled", finite_or_zero(F.try_divide(F.col("n") - lo, hi - lo)))
