"""Joins with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import coerce_int


def enrich_lookup(
    df: DataFrame,
    code: str,
    lookup: DataFrame,
    name: str = "area_name",
    default: str = "",
    drop_unknown: bool = False,
) -> DataFrame:
    """Add the name of a code from `lookup` (code int, name string).

    Codes are compared as numbers, so `8` and `08` are the same. Unknown and
    missing codes get `default` or are dropped. There is no broadcast hint:
    Spark broadcasts the lookup by its measured size, and joins by shuffle with
    its skew handling when it is larger than the configured threshold.
    """
    names = lookup.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    how = "inner" if drop_unknown else "left"
    key = coerce_int(code, default=None)
    return (
        df.join(names, key == F.col("_code"), how)
        .withColumn(name, F.coalesce("_name", F.lit(default)))
        .drop("_code", "_name")
    )
