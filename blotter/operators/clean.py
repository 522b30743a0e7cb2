"""Renaming, typing, null handling and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions import coerce_int, parse_point, parse_ts
from blotter.functions.columns import parse_number
from blotter.schema import INCIDENT_TYPED


def normalize_names(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores."""
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns if " " in c})


def type_incidents(raw: DataFrame) -> DataFrame:
    """All-text incidents to typed ones; text that does not parse becomes null.

    Columns outside the incident schema pass through unchanged, so projected
    tables can be typed as well.
    """
    df = normalize_names(raw)
    wanted = {f.name.lower(): f.dataType for f in INCIDENT_TYPED}

    def typed(name: str) -> Column:
        c = F.col(f"`{name}`")
        target = wanted.get(name.lower())
        if target is None or isinstance(target, T.StringType):
            return c
        if isinstance(target, T.TimestampType):
            return parse_ts(c).alias(name)
        if isinstance(target, T.StructType):
            return parse_point(c).alias(name)
        if isinstance(target, T.IntegerType):
            return coerce_int(c, default=None).alias(name)
        if isinstance(target, T.DoubleType):
            return parse_number(c).alias(name)
        return F.trim(c).try_cast(target).alias(name)

    return df.select(*[typed(c) for c in df.columns])


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in cols]))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with a value in every column (of `subset`)."""
    return df.dropna("any", subset=list(subset) if subset else None)


def completeness_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Row and column counts before and after `drop_incomplete`, in one pass."""
    cols = list(subset) if subset else df.columns
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
    ).withColumn("n_cols", F.lit(len(df.columns)))


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls column by column with constants."""
    return df.fillna(dict(values))


# What missing incident fields are filled with before modelling.
INCIDENT_FILL = {
    "Ward": 0,
    "Community_Area": 0,
    "X_Coordinate": 0,
    "Y_Coordinate": 0,
    "Latitude": 0.0,
    "Longitude": 0.0,
}
RAW_LOCATION_FILL = {"Location": "0.0"}


def fill_incidents(df: DataFrame) -> DataFrame:
    """Zero-fill the fields above, as far as `df` has them.

    Filled coordinates enter later histograms and correlations, so profile a
    table before this step to see what is missing. `Location` is filled only
    where it is still text.
    """
    fill = {k: v for k, v in INCIDENT_FILL.items() if k in df.columns}
    if dict(df.dtypes).get("Location") == "string":
        fill.update(RAW_LOCATION_FILL)
    return fill_const(df, fill)


def columns_of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def features_label(
    df: DataFrame, label: str, exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split a table into its feature columns and its label column."""
    features = [c for c in df.columns if c != label and c not in exclude]
    return df.select(*features), df.select(label)


def null_flags(df: DataFrame) -> DataFrame:
    """The same table shape with true where a value is missing."""
    return df.select(*[F.col(f"`{c}`").isNull().alias(c) for c in df.columns])
