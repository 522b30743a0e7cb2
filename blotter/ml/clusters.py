"""Grouping the rows of a count matrix by the shape of their profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.storage import materialize

#: Times the centres move, and digits at which distances are compared.
ROUNDS, DIGITS = 8, 9


def group_profiles(
    cells: DataFrame, columns: Sequence[object], value: str = "z", k: int = 4, rounds: int = ROUNDS
) -> DataFrame:
    """(row_key, cluster, distance, next_distance) for a long matrix with the given columns.

    The first centre is the row with the smallest key, each further one the row farthest from
    all centres so far (ties: the smaller key); then rows go to their nearest centre (ties: the
    earlier one) and centres to the mean of their rows, up to `rounds` times. Groups are numbered
    by their smallest key; there are fewer than `k` if the rows have fewer shapes. The
    squared distances to the own and to the next centre tell how well a row fits.
    Missing values count as 0. A round reads the rows once and gives `k` rows of centres; no
    two rows are compared.
    """
    points = materialize(
        cells.groupBy("row_key").agg(
            F.array(
                *[
                    F.coalesce(F.max(F.when(F.col("col_key") == F.lit(c), F.col(value))), F.lit(0.0))
                    .cast("double")
                    for c in columns
                ]
            ).alias("point")
        )
    )

    def farthest(centres: list[list[float]]):
        if not centres:
            return points.orderBy("row_key").limit(1).select("point", F.lit(1.0).alias("away"))
        away = F.array_min(_distances(centres))
        return points.withColumn("away", away).orderBy(F.desc("away"), "row_key").limit(1)

    centres: list[list[float]] = []
    while len(centres) < k:
        seed = farthest(centres).first()
        if seed is None or seed["away"] <= 0:
            break
        centres.append(list(seed["point"]))
    if not centres:
        return points.select(
            "row_key", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("next_distance")
        )
    means = [F.avg(F.get("point", F.lit(i))) for i in range(len(columns))]
    for _ in range(rounds):
        moved = list(centres)
        for row in points.groupBy(_nearest(centres).alias("at")).agg(F.array(*means).alias("mean")).collect():
            moved[row["at"]] = list(row["mean"])
        if moved == centres:
            break
        centres = moved
    near = F.sort_array(_distances(centres))
    placed = points.select(
        "row_key", _nearest(centres).alias("_at"),
        F.get(near, F.lit(0)).alias("distance"), F.get(near, F.lit(1)).alias("next_distance"),
    )
    # At most k rows.
    names = placed.groupBy("_at").agg(F.min("row_key").alias("_least"))
    least = F.sort_array(names.agg(F.collect_list("_least").alias("all")).select("all").scalar())
    named = names.withColumn("cluster", (F.array_position(least, F.col("_least")) - 1).cast("int"))
    return (
        placed.join(F.broadcast(named), "_at")
        .select("row_key", "cluster", "distance", "next_distance")
        .orderBy("cluster", "row_key")
    )


def _distances(centres: list[list[float]]) -> Column:
    """The squared distances of `point` to each centre."""

    def one(centre: list[float]) -> Column:
        squares = F.zip_with("point", F.lit(centre), lambda x, c: (x - c) * (x - c))
        return F.round(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b), DIGITS)

    return F.array(*[one(centre) for centre in centres])


def _nearest(centres: list[list[float]]) -> Column:
    distances = _distances(centres)
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
