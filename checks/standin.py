"""Incidents derived from the `orders` table, once for Spark and once for DuckDB.

Every order becomes one raw incident, all columns text. Some dates, wards,
areas, places, codes and coordinates are bad or missing, depending on the status and
priority of the order, and some codes occur once, so that a test side has codes that the
training side has not.
"""

from pyspark.sql import DataFrame

from checks.registry import Tables

_SHARED = {
    "ID": "CAST(o_orderkey AS {text})",
    "Case Number": "concat('C', lpad(CAST(o_orderkey AS {text}), 9, '0'))",
    "Date": (
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' "
        "THEN '2020-13-45' ELSE {stamp} END"
    ),
    "Block": "concat('B', CAST(o_custkey % 500 AS {text}))",
    "IUCR": (
        "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN NULL "
        "ELSE lpad(CAST(o_custkey % 400 AS {text}), 4, '0') END"
    ),
    "Primary Type": "concat(substring(o_orderpriority, 3), ' ', CAST(o_custkey % 6 AS {text}))",
    "Description": "concat('D', CAST(o_custkey % 45 AS {text}))",
    "Location Description": (
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN NULL "
        "ELSE concat('PLACE ', CAST(CAST(floor(sqrt(o_custkey % 900)) AS INT) AS {text})) END"
    ),
    "Arrest": (
        "CASE WHEN (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'O') "
        "OR (o_orderstatus = 'F' AND o_custkey % 6 = 0) THEN 'true' ELSE 'false' END"
    ),
    "Domestic": "CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END",
    "Beat": "CAST(o_custkey % 274 AS {text})",
    "District": "CAST(o_custkey % 25 + 1 AS {text})",
    "Ward": (
        "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN NULL "
        "ELSE CAST(o_custkey % 50 + 1 AS {text}) END"
    ),
    "Community Area": (
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL "
        "ELSE lpad(CAST(o_custkey % 80 AS {text}), 2, '0') END"
    ),
    "FBI Code": (
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL "
        "WHEN o_orderkey % 331 = 0 THEN concat('U', CAST(o_orderkey AS {text})) "
        "ELSE lpad(CAST(o_custkey % 26 AS {text}), 2, '0') END"
    ),
    "X Coordinate": (
        "CASE WHEN {nowhere} THEN NULL "
        "ELSE CAST(1100000 + o_custkey * 7 % 90000 AS {text}) END"
    ),
    "Y Coordinate": (
        "CASE WHEN {nowhere} THEN NULL "
        "ELSE CAST(1800000 + o_custkey * 11 % 90000 AS {text}) END"
    ),
    "Year": "CAST(year(o_orderdate) AS {text})",
    "Updated On": "{updated}",
    "Latitude": "CASE WHEN {nowhere} THEN NULL ELSE {lat} END",
    "Longitude": "CASE WHEN {nowhere} THEN NULL ELSE {long} END",
    "Location": "CASE WHEN {nowhere} THEN NULL ELSE concat('(', {lat}, ', ', {long}, ')') END",
}
_PLACES = {
    "nowhere": "(o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')",
    "lat": "concat('41.', CAST(600 + o_custkey % 400 AS {text}))",
    "long": "concat('-87.', CAST(500 + o_custkey % 300 AS {text}))",
}
_SPARK = {
    "text": "STRING",
    "stamp": (
        "date_format(o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400), "
        "'MM/dd/yyyy hh:mm:ss a')"
    ),
    "updated": "date_format(o_orderdate, 'MM/dd/yyyy hh:mm:ss a')",
}
_DUCKDB = {
    "text": "VARCHAR",
    "stamp": (
        "strftime(o_orderdate + to_seconds(o_orderkey * 7919 % 86400), "
        "'%m/%d/%Y %I:%M:%S %p')"
    ),
    "updated": "strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p')",
}


def _expressions(dialect: dict[str, str]) -> dict[str, str]:
    values = dict(dialect)
    for name, template in _PLACES.items():
        values[name] = template.format(**dialect)
    return {name: template.format(**values) for name, template in _SHARED.items()}


def raw_incidents(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{e} AS `{c}`" for c, e in _expressions(_SPARK).items()])


# `raw` has the columns under their underscore names. `dated` adds the parsed
# timestamp `ts` and keeps rows that have one; `complete` keeps those of them
# without a missing value in the profile columns.
RAW_CTE = "WITH raw AS (SELECT {} FROM orders)".format(
    ", ".join(f"{e} AS {c.replace(' ', '_')}" for c, e in _expressions(_DUCKDB).items())
)
DATED_CTE = (
    RAW_CTE + ", dated AS (SELECT *, try_strptime(Date, '%m/%d/%Y %I:%M:%S %p') AS ts FROM raw "
    "WHERE try_strptime(Date, '%m/%d/%Y %I:%M:%S %p') IS NOT NULL)"
)
COMPLETE_CTE = (
    DATED_CTE + ", complete AS (SELECT * FROM dated WHERE Location_Description IS NOT NULL "
    "AND Location IS NOT NULL AND Latitude IS NOT NULL AND Longitude IS NOT NULL)"
)
