"""Splitting, imputing, compressing and encoding categorical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import unit_hash


def split_by_hash(
    df: DataFrame, key: str, fraction: float = 0.8, seed: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: no shuffle, and the same
    rows every time the plan runs."""
    in_train = unit_hash(key, seed) < fraction
    return df.filter(in_train), df.filter(~in_train)


def folds_by_hash(df: DataFrame, key: str, folds: int, seed: int = 7) -> DataFrame:
    """Add `fold` in 0 .. folds-1 by a hash of the key, without ranking rows."""
    return df.withColumn("fold", F.floor(unit_hash(key, seed) * folds).cast("int"))


def mode_values(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(column, value, n): the most frequent value, the lowest one on ties.

    A row counts `weight` times, if that is given.

    Values are counted across the cluster first; one row per distinct value
    remains for the comparison, which again starts on the map side.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")
            )
            for c in cols
        ]
    )
    size = F.lit(1) if weight is None else F.col(weight)
    counts = (
        df.select(size.alias("_size"), F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.sum("_size").cast("long").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("order"), "value", "n")).alias("best")
    return counts.groupBy("column").agg(best).select("column", "best.value", "best.n")


def apply_modes(df: DataFrame, modes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill missing categories with the values found by `mode_values`.

    There is one row per column, so the values travel as a scalar subquery.
    """
    found = modes.agg(
        F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("modes")
    ).scalar()
    filled = df.withColumn("_modes", found)
    return filled.withColumns(
        {
            c: F.coalesce(
                F.col(c).cast("string"), F.try_element_at("_modes", F.lit(c))
            )
            for c in cols
        }
    ).drop("_modes")


def compress(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per combination of `cols` with its number of rows as `weight`.

    Categorical training data repeats a lot. Fitting on combinations with
    weights gives the same model, and every further pass reads far fewer rows.
    """
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def encoder(cols: Sequence[str], output: str = "features") -> Pipeline:
    """One-hot encoding of text columns; unknown and missing give all zeros.

    The indexer keeps both as one more category, and that last one is dropped.
    """
    index = StringIndexer(
        inputCols=list(cols),
        outputCols=[f"{c}_index" for c in cols],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_index" for c in cols],
        outputCols=[f"{c}_hot" for c in cols],
        dropLast=True,
    )
    join = VectorAssembler(inputCols=[f"{c}_hot" for c in cols], outputCol=output)
    return Pipeline(stages=[index, hot, join])


def one_hot_positions(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Add `position`: the place of the 1 in the one-hot vector of a category.

    A category not seen in training, or a missing one, has no position: its
    vector is all zeros.
    """
    encoded = encoder([column], "_hot").fit(train).transform(df)
    place = F.array_position(vector_to_array("_hot"), 1.0)
    return encoded.select(
        *df.columns, F.nullif(place.cast("int"), F.lit(0)).alias("_place")
    ).select(*df.columns, (F.col("_place") - 1).alias("position"))
