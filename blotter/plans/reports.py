"""One function per question asked of an incident table.

Inputs are raw incidents (text columns under their original names, as read by
`read_incidents_csv`); every report is a composition of the operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter import operators as op
from blotter.functions import parse_ts
from blotter.ml import group_profiles
from blotter.operators.crosstab import HOURS, WEEKDAY_NUMBERS

# The columns the yearly reports and the profile reports work on.
YEARLY_COLUMNS = [
    "ID",
    "Case Number",
    "Date",
    "Block",
    "Community Area",
    "Primary Type",
    "Description",
    "Location",
    "Location Description",
    "Arrest",
    "Domestic",
    "Latitude",
    "Longitude",
]
PROFILE_COLUMNS = [
    "ID",
    "Case Number",
    "Date",
    "Block",
    "Primary Type",
    "Description",
    "Location",
    "Location Description",
    "Arrest",
    "Domestic",
    "Latitude",
    "Longitude",
]

# The features of the classifiers. The case number identifies a
# row and is left out by default.
MODEL_FEATURES = ["IUCR", "Primary_Type", "Domestic", "FBI_Code"]


def dated(raw: DataFrame, cols: Sequence[str] = YEARLY_COLUMNS) -> DataFrame:
    """Projected and renamed incidents with a real timestamp and the year;
    rows whose date does not parse are dropped."""
    df = op.normalize_names(raw.select(*[F.col(f"`{c}`") for c in cols]))
    df = df.withColumn("Date", parse_ts("Date")).withColumn("Year", F.year("Date"))
    return op.require_not_null(df, ["Year"])


def complete(raw: DataFrame) -> DataFrame:
    """The profile columns of incidents without any missing value, with a real
    timestamp. Unparsable dates count as missing."""
    df = op.normalize_names(raw.select(*[F.col(f"`{c}`") for c in PROFILE_COLUMNS]))
    return op.drop_incomplete(df.withColumn("Date", parse_ts("Date")))


def incidents_per_year(raw: DataFrame) -> DataFrame:
    return op.count_by(dated(raw), "Year").orderBy("Year")


def common_types(raw: DataFrame, n: int = 37) -> DataFrame:
    return op.top_n(dated(raw), "Primary_Type", n)


def common_areas(raw: DataFrame, n: int = 25) -> DataFrame:
    return op.top_n(dated(raw), "Community_Area", n)


def common_locations(raw: DataFrame, n: int = 25) -> DataFrame:
    return op.top_n(dated(raw), "Location_Description", n)


def top_type_of_year(raw: DataFrame) -> DataFrame:
    return op.argmax_per_group(dated(raw), "Year", "Primary_Type").orderBy("Year")


def top_three_types_of_year(raw: DataFrame) -> DataFrame:
    return op.top_k_columns(dated(raw), "Year", "Primary_Type", 3).orderBy("Year")


def arrests_by_type(raw: DataFrame) -> DataFrame:
    return op.flag_count(dated(raw), "Primary_Type", "Arrest").orderBy(
        F.desc("n_flag"), "Primary_Type"
    )


def arrest_share_by_type(raw: DataFrame) -> DataFrame:
    """Each type's part of all arrests."""
    return op.share_of_total(dated(raw).filter(F.col("Arrest") == "true"), "Primary_Type")


def arrest_trend(raw: DataFrame) -> DataFrame:
    return op.flag_trend(dated(raw), "Year", "Arrest")


def arrest_rate_by_type(raw: DataFrame) -> DataFrame:
    return op.flag_rate(dated(raw), "Primary_Type", "Arrest").orderBy(
        F.desc("pct"), "Primary_Type"
    )


def arrest_rate_by_area(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Arrests, other incidents and arrest percentage per area name.

    Incidents are counted per code before the names are joined, so the join
    sees one row per code. Codes without a name share the empty name.
    """
    located = op.require_not_null(dated(raw), ["Arrest", "Community_Area"])
    per_code = op.outer_counts(located, "Community_Area", "Arrest")
    return (
        op.enrich_lookup(per_code, "Community_Area", lookup)
        .groupBy("area_name")
        .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
        .withColumn("pct_a", F.try_divide("n_a", F.col("n_a") + F.col("n_b")) * 100)
    )


def incidents_per_month(raw: DataFrame) -> DataFrame:
    return op.monthly_counts(complete(raw), "Date").orderBy("month")


def yearly_rolling_by_type(raw: DataFrame, days: int = 365) -> DataFrame:
    """Rolling total per type over the last `days` days that have incidents."""
    daily = op.daily_counts(complete(raw), "Date", "Primary_Type")
    return op.rolling_on_all_days(daily, days)


def incidents_per_weekday(raw: DataFrame) -> DataFrame:
    return op.count_by_weekday(complete(raw), "Date")


def incidents_per_month_of_year(raw: DataFrame) -> DataFrame:
    return op.count_by_month(complete(raw), "Date")


def hour_pattern(raw: DataFrame, key: str = "Primary_Type") -> DataFrame:
    """Hour counts per key as clipped row z-scores."""
    cells = op.hour_by(complete(raw), "Date", key)
    return op.clip_symmetric(op.zscore_within(cells))


def weekday_pattern(raw: DataFrame, key: str = "Primary_Type") -> DataFrame:
    """Weekday counts per key as clipped row z-scores."""
    cells = op.weekday_by(complete(raw), "Date", key)
    return op.clip_symmetric(op.zscore_within(cells))


def week_pattern(raw: DataFrame) -> DataFrame:
    """Hour counts per weekday as clipped row z-scores, Monday first."""
    cells = op.weekday_by_hour(complete(raw), "Date")
    return op.clip_symmetric(op.zscore_within(cells)).orderBy("weekday", "col_key")


def hour_groups(raw: DataFrame, key: str = "Primary_Type", k: int = 4) -> DataFrame:
    """Keys grouped by the shape of their day."""
    cells = op.zscore_within(op.hour_by(complete(raw), "Date", key))
    return group_profiles(cells, HOURS, "z", k)


def weekday_groups(raw: DataFrame, key: str = "Primary_Type", k: int = 4) -> DataFrame:
    """Keys grouped by the shape of their week."""
    cells = op.zscore_within(op.weekday_by(complete(raw), "Date", key))
    return group_profiles(cells, WEEKDAY_NUMBERS, "z", k)


def places_of_top_types(raw: DataFrame, k: int = 10) -> DataFrame:
    """Where the `k` most common types happen, scaled per place."""
    return op.top_columns_matrix(complete(raw), "Location_Description", "Primary_Type", k)


def place_groups(raw: DataFrame, k: int = 10, groups: int = 3) -> DataFrame:
    """Places grouped by their mix of the `k` most common types.

    Columns are the ranks of the types within a place's row, which are the
    same for every place because each row lists the same types in name order.
    """
    cells = places_of_top_types(raw, k)
    numbered = cells.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("col_key", "scaled"))).alias("_row")
    )
    long = numbered.select("row_key", F.posexplode("_row").alias("col_key", "_cell")).select(
        "row_key", "col_key", F.col("_cell.scaled").alias("scaled")
    )
    return group_profiles(long, list(range(k)), "scaled", groups)


def hot_locations(raw: DataFrame, n: int = 1000) -> DataFrame:
    return op.hotspots(complete(raw), "Location", n)


def cleaned(raw: DataFrame) -> DataFrame:
    """Typed incidents with missing fields zero-filled and date parts added."""
    df = op.fill_incidents(op.type_incidents(raw))
    parts = op.time_parts(df, "Date", "day", "month", "time")
    return parts.withColumnsRenamed({"day": "Day", "month": "Month", "time": "Time"})


def quality_profile(raw: DataFrame) -> DataFrame:
    return op.profile(op.normalize_names(raw))


def correlations(raw: DataFrame) -> DataFrame:
    return op.corr_matrix(cleaned(raw))


def incidents_per_district(raw: DataFrame) -> DataFrame:
    """Incidents per district beside the mean over the districts."""
    return op.count_vs_mean(op.normalize_names(raw), "District")


def places_smallest_first(raw: DataFrame, n: int = 20) -> DataFrame:
    """The `n` commonest places, the smallest count first."""
    return op.top_n(complete(raw), "Location_Description", n, ascending_output=True)


def incident_summary(raw: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, spread, ends and quartiles of the numeric columns of the cleaned table."""
    return op.describe(cleaned(raw), cols)


def incident_histograms(
    raw: DataFrame, cols: Sequence[str] | None = None, bins: int | str = 10
) -> DataFrame:
    """Equal-width histograms of the numeric columns of the cleaned table."""
    return op.histogram(cleaned(raw), cols, bins)


def incident_density(raw: DataFrame, column: str) -> DataFrame:
    """The density of a numeric column of the cleaned table."""
    return op.density(cleaned(raw), column)


def model_table(raw: DataFrame) -> DataFrame:
    """(ID, features as text, label 0/1) for the classifiers."""
    df = op.normalize_names(raw)
    return df.select(
        F.col("ID").cast("long").alias("ID"),
        *MODEL_FEATURES,
        (F.lower("Arrest") == "true").cast("int").alias("label"),
    ).filter(F.col("label").isNotNull())


__all__ = [
    "MODEL_FEATURES",
    "PROFILE_COLUMNS",
    "YEARLY_COLUMNS",
    "arrest_rate_by_area",
    "arrest_rate_by_type",
    "arrest_share_by_type",
    "arrest_trend",
    "arrests_by_type",
    "cleaned",
    "common_areas",
    "common_locations",
    "common_types",
    "complete",
    "correlations",
    "dated",
    "hot_locations",
    "hour_groups",
    "hour_pattern",
    "incident_density",
    "incident_histograms",
    "incident_summary",
    "incidents_per_district",
    "incidents_per_month",
    "incidents_per_month_of_year",
    "incidents_per_weekday",
    "incidents_per_year",
    "model_table",
    "place_groups",
    "places_of_top_types",
    "places_smallest_first",
    "quality_profile",
    "top_three_types_of_year",
    "top_type_of_year",
    "week_pattern",
    "weekday_groups",
    "weekday_pattern",
    "yearly_rolling_by_type",
]
