"""The reports on incidents, on incidents derived from the orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter import operators as op
from blotter import plans
from blotter.ml.clusters import DIGITS, ROUNDS
from blotter.schema import RAW_COLUMNS
from blotter.sources import AREA_TEXT, area_lookup
from checks.registry import Tables, dates_as_text, query, rounded
from checks.standin import COMPLETE_CTE, DATED_CTE, RAW_CTE, raw_incidents

_TYPE_YEAR = (
    DATED_CTE + ", c AS (SELECT CAST(year(ts) AS INTEGER) AS Year, Primary_Type, count(*) AS n "
    "FROM dated GROUP BY 1, 2) "
)


@query(
    DATED_CTE + "SELECT CAST(year(ts) AS INTEGER) AS Year, count(*) AS n FROM dated GROUP BY 1"
)
def incidents_per_year(t: Tables) -> DataFrame:
    return plans.incidents_per_year(raw_incidents(t))


def _top_sql(column: str, n: int) -> str:
    return (
        DATED_CTE + f"SELECT {column}, count(*) AS n FROM dated GROUP BY 1 "
        f"ORDER BY n DESC, {column} ASC NULLS FIRST LIMIT {n}"
    )


@query(_top_sql("Primary_Type", 37))
def common_types(t: Tables) -> DataFrame:
    return plans.common_types(raw_incidents(t))


@query(_top_sql("Community_Area", 25))
def common_areas(t: Tables) -> DataFrame:
    return plans.common_areas(raw_incidents(t))


@query(_top_sql("Location_Description", 25))
def common_locations(t: Tables) -> DataFrame:
    return plans.common_locations(raw_incidents(t))


@query(
    _TYPE_YEAR + "SELECT c.Year, Primary_Type, n FROM c JOIN "
    "(SELECT Year, max(n) AS m FROM c GROUP BY Year) m ON c.Year = m.Year AND n = m"
)
def top_type_of_year(t: Tables) -> DataFrame:
    return plans.top_type_of_year(raw_incidents(t))


@query(
    _TYPE_YEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY Year "
    "ORDER BY n DESC, Primary_Type DESC) AS k FROM c) SELECT Year, "
    + ", ".join(
        f"max(Primary_Type) FILTER (WHERE k = {i}) AS type_{i}, "
        f"max(n) FILTER (WHERE k = {i}) AS n_{i}"
        for i in (1, 2, 3)
    )
    + " FROM r GROUP BY Year"
)
def top_three_types_of_year(t: Tables) -> DataFrame:
    tops = plans.top_three_types_of_year(raw_incidents(t))
    flat = [
        c
        for i in (1, 2, 3)
        for c in (
            F.col(f"top_{i}.Primary_Type").alias(f"type_{i}"),
            F.col(f"top_{i}.n").alias(f"n_{i}"),
        )
    ]
    return tops.select("Year", *flat)


@query(
    DATED_CTE + "SELECT Primary_Type, count(*) FILTER (WHERE Arrest = 'true') AS n_flag "
    "FROM dated GROUP BY 1"
)
def arrests_by_type(t: Tables) -> DataFrame:
    return plans.arrests_by_type(raw_incidents(t))


@query(
    DATED_CTE + "SELECT Primary_Type, count(*) AS n, round(count(*) * 100.0 / "
    "(SELECT count(*) FROM dated WHERE Arrest = 'true'), 6) AS pct FROM dated "
    "WHERE Arrest = 'true' GROUP BY 1"
)
def arrest_share_by_type(t: Tables) -> DataFrame:
    return rounded(plans.arrest_share_by_type(raw_incidents(t)), "pct")


@query(
    DATED_CTE + ", p AS (SELECT CAST(year(ts) AS INTEGER) AS Year, "
    "nullif(count(*) FILTER (WHERE Arrest = 'true'), 0) AS a, "
    "nullif(count(*) FILTER (WHERE Arrest = 'false'), 0) AS b FROM dated GROUP BY 1) "
    'SELECT Year, a AS "true", b AS "false", a + b AS total, '
    "round(a * 100.0 / (a + b), 6) AS pct FROM p"
)
def arrest_trend(t: Tables) -> DataFrame:
    return rounded(plans.arrest_trend(raw_incidents(t)), "pct")


@query(
    DATED_CTE + "SELECT Primary_Type, count(*) FILTER (WHERE Arrest = 'true') AS n_flag, "
    "count(*) AS n, "
    "round(count(*) FILTER (WHERE Arrest = 'true') * 100.0 / count(*), 6) AS pct "
    "FROM dated GROUP BY 1"
)
def arrest_rate_by_type(t: Tables) -> DataFrame:
    return rounded(plans.arrest_rate_by_type(raw_incidents(t)), "pct")


_AREAS = ", ".join(
    "({}, '{}')".format(int(line.split(" ", 1)[0]), line.split(" ", 1)[1].replace("'", "''"))
    for line in AREA_TEXT.strip().splitlines()
)


@query(
    DATED_CTE + f", areas(code, name) AS (VALUES {_AREAS}) "
    "SELECT coalesce(name, '') AS area_name, "
    "count(*) FILTER (WHERE Arrest = 'true') AS n_a, "
    "count(*) FILTER (WHERE Arrest = 'false') AS n_b, "
    "round(count(*) FILTER (WHERE Arrest = 'true') * 100.0 / count(*), 6) AS pct_a "
    "FROM dated LEFT JOIN areas ON CAST(Community_Area AS INTEGER) = code "
    "WHERE Community_Area IS NOT NULL GROUP BY 1"
)
def arrest_rate_by_area(t: Tables) -> DataFrame:
    rates = plans.arrest_rate_by_area(raw_incidents(t), area_lookup(t.spark))
    return rounded(rates, "pct_a")


@query(
    COMPLETE_CTE + "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) AS n "
    "FROM complete GROUP BY 1"
)
def incidents_per_month(t: Tables) -> DataFrame:
    return dates_as_text(plans.incidents_per_month(raw_incidents(t)), "month")


@query(
    COMPLETE_CTE + ", c AS (SELECT strftime(ts, '%Y-%m-%d') AS row_key, Primary_Type AS col_key, "
    "count(*) AS n FROM complete GROUP BY 1, 2), d AS (SELECT a.row_key, b.col_key, "
    "coalesce(n, 0) AS n FROM (SELECT DISTINCT row_key FROM c) a CROSS JOIN "
    "(SELECT DISTINCT col_key FROM c) b LEFT JOIN c ON c.row_key = a.row_key "
    "AND c.col_key = b.col_key) SELECT row_key, col_key, n, "
    "CASE WHEN count(n) OVER w >= 365 THEN CAST(sum(n) OVER w AS BIGINT) END AS rolling FROM d "
    "WINDOW w AS (PARTITION BY col_key ORDER BY row_key "
    "ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)"
)
def yearly_rolling_by_type(t: Tables) -> DataFrame:
    return dates_as_text(plans.yearly_rolling_by_type(raw_incidents(t)), "row_key")


@query(
    COMPLETE_CTE + "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, count(*) AS n "
    "FROM complete GROUP BY 1"
)
def incidents_per_weekday(t: Tables) -> DataFrame:
    return plans.incidents_per_weekday(raw_incidents(t))


@query(
    COMPLETE_CTE + "SELECT CAST(month(ts) AS INTEGER) AS month, count(*) AS n "
    "FROM complete GROUP BY 1"
)
def incidents_per_month_of_year(t: Tables) -> DataFrame:
    return plans.incidents_per_month_of_year(raw_incidents(t))


def _pattern_sql(row: str, part: str, n_cols: int, select: str) -> str:
    return (
        COMPLETE_CTE + f", c AS (SELECT {row} AS row_key, CAST({part} AS INTEGER) AS col_key, "
        "count(*) AS n FROM complete GROUP BY 1, 2), d AS (SELECT r.row_key, k.col_key, "
        "coalesce(n, 0) AS n FROM (SELECT DISTINCT row_key FROM c) r CROSS JOIN "
        f"(SELECT CAST(range AS INTEGER) AS col_key FROM range({n_cols})) k LEFT JOIN c "
        "ON c.row_key = r.row_key AND c.col_key = k.col_key), "
        "z AS (SELECT *, (n - avg(n) OVER (PARTITION BY row_key)) / "
        "stddev_samp(n) OVER (PARTITION BY row_key) AS z FROM d), "
        "cap AS (SELECT least(max(z), abs(min(z))) AS cap FROM z) "
        f"SELECT {select}, col_key, n, "
        "round(greatest(least(z, (SELECT cap FROM cap)), -(SELECT cap FROM cap)), 6) AS z FROM z"
    )


@query(_pattern_sql("Primary_Type", "hour(ts)", 24, "row_key"))
def hour_pattern(t: Tables) -> DataFrame:
    return rounded(plans.hour_pattern(raw_incidents(t)), "z")


@query(_pattern_sql("Location_Description", "hour(ts)", 24, "row_key"))
def hour_pattern_by_location(t: Tables) -> DataFrame:
    return rounded(plans.hour_pattern(raw_incidents(t), "Location_Description"), "z")


@query(_pattern_sql("Primary_Type", "isodow(ts) - 1", 7, "row_key"))
def weekday_pattern(t: Tables) -> DataFrame:
    return rounded(plans.weekday_pattern(raw_incidents(t)), "z")


@query(
    _pattern_sql(
        "CAST(isodow(ts) - 1 AS INTEGER)",
        "hour(ts)",
        24,
        "row_key AS weekday, dayname(DATE '2024-01-01' + row_key) AS row_key",
    )
)
def week_pattern(t: Tables) -> DataFrame:
    return rounded(plans.week_pattern(raw_incidents(t)), "z")


@query(
    COMPLETE_CTE + ", c AS (SELECT Location_Description AS row_key, Primary_Type AS col_key, "
    "count(*) AS n FROM complete GROUP BY 1, 2), k AS (SELECT col_key FROM c GROUP BY col_key "
    "ORDER BY sum(n) DESC, col_key LIMIT 10), d AS (SELECT r.row_key, k.col_key, "
    "coalesce(n, 0) AS n FROM (SELECT DISTINCT row_key FROM c) r CROSS JOIN k LEFT JOIN c "
    "ON c.row_key = r.row_key AND c.col_key = k.col_key) "
    "SELECT row_key, col_key, n, round(coalesce((n - min(n) OVER (PARTITION BY row_key)) / "
    "nullif(max(n) OVER (PARTITION BY row_key) - min(n) OVER (PARTITION BY row_key), 0)::DOUBLE, "
    "0.0), 6) AS scaled FROM d"
)
def places_of_top_types(t: Tables) -> DataFrame:
    return rounded(plans.places_of_top_types(raw_incidents(t)), "scaled")


@query(
    COMPLETE_CTE + "SELECT CAST(Latitude AS DOUBLE) AS lat, CAST(Longitude AS DOUBLE) AS long, "
    "n, round(n / 45.0, 6) AS radius, n > 2000 AS is_hot FROM (SELECT Location, Latitude, "
    "Longitude, count(*) AS n FROM complete GROUP BY 1, 2, 3 ORDER BY n DESC, Location "
    "LIMIT 1000) x"
)
def hot_locations(t: Tables) -> DataFrame:
    return rounded(plans.hot_locations(raw_incidents(t)), "radius")


@query(
    DATED_CTE + ", k AS (SELECT Location_Description AS v FROM dated "
    "WHERE Location_Description IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20), "
    "b AS (SELECT CASE WHEN Location_Description IS NULL THEN NULL "
    "WHEN Location_Description IN (SELECT v FROM k) THEN Location_Description "
    "ELSE 'OTHER' END AS Location_Description FROM dated) "
    "SELECT Location_Description, count(*) AS n FROM b GROUP BY 1"
)
def locations_with_other(t: Tables) -> DataFrame:
    bucketed = op.bucket_other(plans.dated(raw_incidents(t)), "Location_Description")
    return op.count_by(bucketed, "Location_Description")


_CLEAN_SQL = (
    RAW_CTE + ", clean AS (SELECT CAST(ID AS BIGINT) AS ID, "
    "CAST(coalesce(Ward, '0') AS INTEGER) AS Ward, "
    "CAST(coalesce(Community_Area, '0') AS INTEGER) AS Community_Area, "
    "CAST(coalesce(X_Coordinate, '0') AS INTEGER) AS X_Coordinate, "
    "CAST(coalesce(Y_Coordinate, '0') AS INTEGER) AS Y_Coordinate, "
    "CAST(coalesce(Latitude, '0') AS DOUBLE) AS Latitude, "
    "CAST(coalesce(Longitude, '0') AS DOUBLE) AS Longitude, "
    "CAST(Arrest AS BOOLEAN) AS Arrest, CAST(Domestic AS BOOLEAN) AS Domestic, "
    "CAST(Beat AS INTEGER) AS Beat, CAST(District AS INTEGER) AS District, "
    "CAST(Year AS INTEGER) AS Year, "
    "CAST(day(try_strptime(Date, '%m/%d/%Y %I:%M:%S %p')) AS INTEGER) AS Day, "
    "CAST(month(try_strptime(Date, '%m/%d/%Y %I:%M:%S %p')) AS INTEGER) AS Month, "
    "strftime(try_strptime(Date, '%m/%d/%Y %I:%M:%S %p'), '%H:%M:%S') AS Time FROM raw) "
)
_CLEAN_COLS = [
    "ID",
    "Ward",
    "Community_Area",
    "X_Coordinate",
    "Y_Coordinate",
    "Latitude",
    "Longitude",
    "Arrest",
    "Domestic",
    "Beat",
    "District",
    "Year",
    "Day",
    "Month",
]


@query(_CLEAN_SQL + "SELECT * FROM clean")
def cleaned_incidents(t: Tables) -> DataFrame:
    return plans.cleaned(raw_incidents(t)).select(*_CLEAN_COLS, "Time")


@query(
    _CLEAN_SQL
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM clean"
        for a in _CLEAN_COLS
        for b in _CLEAN_COLS
    )
)
def correlations(t: Tables) -> DataFrame:
    return rounded(plans.correlations(raw_incidents(t)), "r")


@query(
    RAW_CTE
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'string' AS type, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM raw"
        for c in (name.replace(" ", "_") for name in RAW_COLUMNS)
    )
)
def quality_profile(t: Tables) -> DataFrame:
    return rounded(plans.quality_profile(raw_incidents(t)), "null_pct")


def groups_sql(cells: str, k: int, rounds: int = ROUNDS) -> str:
    """The grouping of a matrix; `cells` are CTEs, the last of them `cells` (row_key, col_key, v)."""
    distance = f"round(sum((p.v - c.v) * (p.v - c.v)), {DIGITS})"
    ctes = [
        cells,
        "points AS MATERIALIZED (SELECT row_key, col_key, coalesce(v, 0)::DOUBLE AS v FROM cells)",
        "seed1 AS MATERIALIZED (SELECT 0 AS g, min(row_key) AS row_key FROM points)",
    ]
    for j in range(2, k + 1):
        ctes.append(
            f"seed{j} AS MATERIALIZED (SELECT * FROM seed{j - 1} UNION ALL SELECT {j - 1}, row_key FROM "
            "(SELECT row_key, min(d) AS d FROM (SELECT p.row_key, s.g, "
            f"{distance} AS d FROM points p JOIN seed{j - 1} s ON true JOIN points c "
            "ON c.row_key = s.row_key AND c.col_key = p.col_key GROUP BY 1, 2) x GROUP BY 1 "
            "HAVING min(d) > 0 ORDER BY d DESC, row_key LIMIT 1) y)"
        )
    ctes.append(
        f"centre0 AS MATERIALIZED (SELECT g, col_key, v FROM seed{k} JOIN points USING (row_key))"
    )
    for r in range(rounds + 1):
        ctes.append(
            f"apart{r} AS MATERIALIZED (SELECT p.row_key, c.g, {distance} AS d FROM points p JOIN centre{r} c "
            "ON c.col_key = p.col_key GROUP BY 1, 2)"
        )
        ctes.append(
            f"near{r} AS MATERIALIZED (SELECT row_key, g, d, row_number() OVER "
            f"(PARTITION BY row_key ORDER BY d, g) AS place FROM apart{r})"
        )
        if r < rounds:
            ctes.append(
                f"centre{r + 1} AS MATERIALIZED (SELECT o.g, o.col_key, coalesce(m.v, o.v) AS v FROM centre{r} o "
                f"LEFT JOIN (SELECT g, col_key, avg(v) AS v FROM points JOIN near{r} USING (row_key) "
                "WHERE place = 1 GROUP BY 1, 2) m ON m.g = o.g AND m.col_key = o.col_key)"
            )
    return (
        ", ".join(ctes)
        + f", named AS (SELECT g, CAST(row_number() OVER (ORDER BY min(row_key)) - 1 AS INTEGER) AS cluster "
        f"FROM near{rounds} WHERE place = 1 GROUP BY g) SELECT n.row_key, cluster, "
        f"round(n.d, 6) AS distance, round(x.d, 6) AS next_distance FROM near{rounds} n JOIN named USING (g) "
        f"LEFT JOIN near{rounds} x ON x.row_key = n.row_key AND x.place = 2 WHERE n.place = 1"
    )


def _profile_cells(key: str, part: str, width: int) -> str:
    """CTEs of the dense counts of a key and a part of the time as row z-scores."""
    return (
        COMPLETE_CTE + f", c AS (SELECT {key} AS row_key, {part} AS col_key, count(*) AS n "
        "FROM complete GROUP BY 1, 2), dense AS (SELECT r.row_key, k.range AS col_key, "
        f"coalesce(n, 0) AS n FROM (SELECT DISTINCT row_key FROM c) r, range({width}) k "
        "LEFT JOIN c ON c.row_key = r.row_key AND c.col_key = k.range), "
        "cells AS (SELECT row_key, col_key, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS v "
        "FROM dense WINDOW w AS (PARTITION BY row_key))"
    )


@query(groups_sql(_profile_cells("Primary_Type", "hour(ts)", 24), 4))
def hour_groups(t: Tables) -> DataFrame:
    return rounded(plans.hour_groups(raw_incidents(t)), "distance", "next_distance")


@query(groups_sql(_profile_cells("Primary_Type", "isodow(ts) - 1", 7), 4))
def weekday_groups(t: Tables) -> DataFrame:
    return rounded(plans.weekday_groups(raw_incidents(t)), "distance", "next_distance")


_PLACE_CELLS = (
    COMPLETE_CTE + ", c AS (SELECT Location_Description AS row_key, Primary_Type AS kind, "
    "count(*) AS n FROM complete GROUP BY 1, 2), k AS (SELECT kind FROM c GROUP BY kind "
    "ORDER BY sum(n) DESC, kind LIMIT 10), d AS (SELECT r.row_key, k.kind, coalesce(n, 0) AS n "
    "FROM (SELECT DISTINCT row_key FROM c) r CROSS JOIN k LEFT JOIN c ON c.row_key = r.row_key "
    "AND c.kind = k.kind), cells AS (SELECT row_key, row_number() OVER (PARTITION BY row_key "
    "ORDER BY kind) AS col_key, coalesce((n - min(n) OVER w) / "
    "nullif(max(n) OVER w - min(n) OVER w, 0)::DOUBLE, 0.0) AS v FROM d WINDOW w AS (PARTITION BY row_key))"
)


@query(groups_sql(_PLACE_CELLS, 3))
def place_groups(t: Tables) -> DataFrame:
    return rounded(plans.place_groups(raw_incidents(t)), "distance", "next_distance")


# ---- counts against the mean, smallest first, and the quality of the table ----------------


@query(
    RAW_CTE + ", c AS (SELECT District, count(*) AS n FROM raw GROUP BY 1) "
    "SELECT District, n, round((SELECT avg(n) FROM c), 6) AS mean_n FROM c"
)
def incidents_per_district(t: Tables) -> DataFrame:
    return rounded(plans.incidents_per_district(raw_incidents(t)), "mean_n")


@query(
    COMPLETE_CTE + "SELECT Location_Description, n FROM (SELECT Location_Description, count(*) AS n "
    "FROM complete GROUP BY 1 ORDER BY n DESC, Location_Description LIMIT 20) x"
)
def places_smallest_first(t: Tables) -> DataFrame:
    return plans.places_smallest_first(raw_incidents(t))


_MEASURED = ["Beat", "District", "Latitude", "Longitude", "Year"]
_STATS = {
    "count": "count({c})",
    "mean": "avg({c})",
    "std": "stddev_samp({c})",
    "min": "min({c})",
    "25%": "quantile_cont({c}, 0.25)",
    "50%": "quantile_cont({c}, 0.5)",
    "75%": "quantile_cont({c}, 0.75)",
    "max": "max({c})",
}


@query(
    _CLEAN_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{stat}' AS stat, "
        f"round(CAST({e.format(c=f'CAST({c} AS DOUBLE)')} AS DOUBLE), 6) AS value FROM clean"
        for c in _MEASURED
        for stat, e in _STATS.items()
    )
)
def incident_summary(t: Tables) -> DataFrame:
    return rounded(plans.incident_summary(raw_incidents(t), _MEASURED), "value")


@query(
    _CLEAN_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(b.range AS INTEGER) AS bin, round(lo + b.range * width, 6) AS lo, "
        f"round(lo + (b.range + 1) * width, 6) AS hi, (SELECT count(*) FROM clean WHERE "
        f"least(floor(({c} - lo) / width), 9) = b.range) AS n FROM (SELECT min({c})::DOUBLE AS lo, "
        f"(max({c}) - min({c}))::DOUBLE / 10 AS width FROM clean) e, range(10) b"
        for c in _MEASURED
    )
)
def incident_histograms(t: Tables) -> DataFrame:
    return rounded(plans.incident_histograms(raw_incidents(t), _MEASURED), "lo", "hi")


@query(
    _CLEAN_SQL + ", s AS (SELECT count(*)::DOUBLE AS n, min(Beat)::DOUBLE AS lo, max(Beat)::DOUBLE AS hi, "
    "stddev_samp(Beat) * pow(count(*)::DOUBLE, -0.2) AS h FROM clean), v AS (SELECT Beat, count(*) AS k "
    "FROM clean GROUP BY 1), g AS (SELECT lo + range * ((hi - lo) / 199) AS x FROM range(200), s) "
    "SELECT round(x, 6) AS x, round(sum(k * exp(-0.5 * ((x - Beat) / h) * ((x - Beat) / h))) / "
    "(max(n) * max(h) * sqrt(2 * pi())), 9) AS density FROM g, v, s GROUP BY x"
)
def beat_density(t: Tables) -> DataFrame:
    found = plans.incident_density(raw_incidents(t), "Beat")
    return rounded(rounded(found, "x"), "density", digits=9)
