"""Most frequent items, per group and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blotter.operators.counts import count_by


def argmax_per_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, n): the most frequent item of each group, ties included.

    Filtering on the rank lets Spark drop all but the leading rows of a group
    before the shuffle, so the number of items in a group does not matter.
    """
    best = F.rank().over(Window.partitionBy(group).orderBy(F.desc("n")))
    return (
        count_by(df, group, item).withColumn("_rank", best).filter("_rank = 1").drop("_rank")
    )


def top_k_per_group(
    df: DataFrame, group: str, item: str, k: int = 3, keep_rank: bool = False
) -> DataFrame:
    """(group, item, n): the `k` most frequent items of each group.

    Equal counts are ordered by item, descending.
    """
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.desc(item))
    top = (
        count_by(df, group, item)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
    return top if keep_rank else top.drop("rank")


def top_k_columns(df: DataFrame, group: str, item: str, k: int = 3) -> DataFrame:
    """One row per group with columns `top_1` .. `top_k`: structs (n, item).

    A column is null where the group has fewer items. At most `k` structs per
    group are gathered.
    """
    ranked = F.sort_array(F.collect_list(F.struct("n", item)), asc=False)
    tops = top_k_per_group(df, group, item, k).groupBy(group).agg(ranked.alias("_top"))
    return tops.select(
        group, *[F.try_element_at("_top", F.lit(i)).alias(f"top_{i}") for i in range(1, k + 1)]
    )


def bucket_other(df: DataFrame, column: str, keep: int = 20, other: str = "OTHER") -> DataFrame:
    """Replace values outside the `keep` most frequent ones by `other`.

    Nulls stay null. Equal counts at the border are ordered by value. The kept
    set has at most `keep` rows, which is what is broadcast.
    """
    frequent = (
        count_by(df.filter(F.col(column).isNotNull()), column)
        .orderBy(F.desc("n"), F.asc(column))
        .limit(keep)
        .select(F.col(column).alias("_kept"))
    )
    kept = F.when(F.col(column).isNull(), F.lit(None)).otherwise(
        F.coalesce("_kept", F.lit(other))
    )
    return (
        df.join(F.broadcast(frequent), F.col(column) == F.col("_kept"), "left")
        .withColumn(column, kept)
        .drop("_kept")
    )
