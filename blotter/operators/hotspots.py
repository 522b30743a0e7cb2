"""Frequent locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import parse_point
from blotter.operators.counts import count_by


def location_counts(df: DataFrame, location: str) -> DataFrame:
    """(location, lat, long, n) per distinct location text.

    Text is counted first and parsed once per distinct value; text that does
    not parse is left out. The condition on the count keeps Spark from moving
    the parsing in front of the aggregation.
    """
    counts = count_by(df.filter(F.col(location).isNotNull()), location)
    return (
        counts.withColumn("_point", F.when(F.col("n") > 0, parse_point(location)))
        .select(location, "_point.lat", "_point.long", "n")
        .filter(F.col("lat").isNotNull())
    )


def hotspots(
    df: DataFrame, location: str, n: int = 1000, scale: float = 45, hot: int = 2000
) -> DataFrame:
    """The `n` most frequent locations with a radius and a hot flag.

    Equal counts are ordered by location text.
    """
    return (
        location_counts(df, location)
        .orderBy(F.desc("n"), F.asc(location))
        .limit(n)
        .select(
            "lat",
            "long",
            "n",
            (F.col("n") / F.lit(float(scale))).alias("radius"),
            (F.col("n") > hot).alias("is_hot"),
        )
    )
