"""Scans, projections, counts, rates, rankings, calendars and matrices."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter import operators as op
from blotter import sources
from blotter.functions import coerce_int, finite_or_zero, format_ts, parse_point, parse_ts
from blotter.operators.crosstab import HOURS, WEEKDAY_NUMBERS
from blotter.operators.timeparts import part
from blotter.storage import new_path
from checks.registry import Tables, dates_as_text, query, rounded

# ---- scans and sinks ---------------------------------------------------------


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "o_orderstatus, o_orderpriority FROM orders"
)
def csv_roundtrip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "csv")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    sources.write_csv(t.orders.select(*cols), path)
    return sources.read_incidents_csv(t.spark, path, required=cols)


@query("SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, l_quantity, l_returnflag FROM lineitem")
def csv_inferred(t: Tables) -> DataFrame:
    path = new_path(t.spark, "csv")
    cols = ["l_orderkey", "l_quantity", "l_returnflag"]
    sources.write_csv(t.lineitem.select(*cols), path)
    return sources.read_incidents_csv(t.spark, path, required=cols, infer=True)


def _saved_customers(t: Tables) -> DataFrame:
    name = f"customers_{uuid.uuid4().hex}"
    kept = t.customer.select("c_custkey", "c_name", "c_nationkey")
    return sources.save_table(
        kept, name, partition_by=["c_nationkey"], path=new_path(t.spark, "table")
    )


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def table_roundtrip(t: Tables) -> DataFrame:
    return _saved_customers(t)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3")
def table_pruned(t: Tables) -> DataFrame:
    return _saved_customers(t).filter("c_nationkey = 3")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 25")
def sql_view_top_n(t: Tables) -> DataFrame:
    sources.register(t.part, "Part_View")
    return t.spark.sql(
        "SELECT P_Name AS p_name, count(*) AS n FROM part_view "
        "GROUP BY p_name ORDER BY n DESC, p_name LIMIT 25"
    )


@query("SELECT * FROM region")
def sql_view_scan(t: Tables) -> DataFrame:
    sources.register(t.region, "region_view")
    return sources.scan_view(t.spark, "region_view")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10000")
def take_first(t: Tables) -> DataFrame:
    cols = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return sources.take_first(cols, 10000, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders LIMIT 10000")
def first_rows_of_files(t: Tables) -> DataFrame:
    found = sources.first_rows(t.spark, f"{t.folder}/orders.parquet", 10000)
    return found.select("o_orderkey", "o_custkey", "o_orderpriority")


_ORDER_TEXT = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
    "o_custkey": "CAST(o_custkey AS VARCHAR)",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "o_totalprice",
    "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')",
    "o_orderpriority": "o_orderpriority",
}


@query(f"SELECT {', '.join(f'{e} AS {c}' for c, e in _ORDER_TEXT.items())} FROM orders")
def csv_mixed_headers(t: Tables) -> DataFrame:
    """All columns, written in two orders and read together."""
    path = new_path(t.spark, "csv")
    orders = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    even = F.col("o_orderkey") % 2 == 0
    sources.write_csv(orders.filter(even), f"{path}/even")
    backwards = orders.filter(~even).select(*reversed(orders.columns))
    sources.write_csv(backwards.withColumn("further", F.lit("x")), f"{path}/odd")
    read = sources.read_incidents_csv(t.spark, [f"{path}/even", f"{path}/odd"], required=list(_ORDER_TEXT))
    return read.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 "
    "UNION ALL SELECT 'all', count(*), round(sum(o_totalprice), 2) FROM orders"
)
def cached_twice(t: Tables) -> DataFrame:
    """Two reports of one cached table."""
    kept = sources.keep_cached(t.orders.select("o_orderstatus", "o_totalprice"))
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    per_status = kept.groupBy("o_orderstatus").agg(*sums)
    whole = kept.agg(*sums).select(F.lit("all").alias("o_orderstatus"), "n", "total")
    return per_status.unionByName(whole)


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount "
    "FROM lineitem"
)
def numeric_features(t: Tables) -> DataFrame:
    numbers = op.columns_of_type(t.lineitem, T.NumericType)
    return op.features_label(t.lineitem.select(*numbers), "l_tax")[0]


@query("SELECT l_tax FROM lineitem")
def label_column(t: Tables) -> DataFrame:
    return op.features_label(t.lineitem, "l_tax")[1]


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def concat_chunks(t: Tables) -> DataFrame:
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    chunks = [t.orders.filter(F.col("o_orderstatus") == s).select(*cols) for s in "FOP"]
    return sources.concat(*chunks)


# ---- projections, filters, nulls -----------------------------------------------


@query(
    "SELECT c_custkey AS Customer_Key, c_name AS Customer_Name, c_mktsegment AS Market_Segment "
    "FROM customer WHERE c_mktsegment = 'BUILDING' AND nullif(c_nationkey, 7) IS NOT NULL"
)
def project_rename_filter(t: Tables) -> DataFrame:
    spaced = t.customer.select(
        F.col("c_custkey").alias("Customer Key"),
        F.col("c_name").alias("Customer Name"),
        F.col("c_mktsegment").alias("Market Segment"),
        F.nullif("c_nationkey", F.lit(7)).alias("Nation Key"),
    )
    named = op.normalize_names(spaced)
    kept = op.require_not_null(named, ["Nation_Key", "Market_Segment"])
    return kept.filter(F.col("Market_Segment") == "BUILDING").drop("Nation_Key")


_WITH_GAPS = (
    "WITH gaps AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand, "
    "nullif(p_type, 'SMALL') AS kind, nullif(p_size, 10) AS size FROM part) "
)


def _part_with_gaps(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#7")).alias("brand"),
        F.nullif("p_type", F.lit("SMALL")).alias("kind"),
        F.nullif("p_size", F.lit(10)).alias("size"),
    )


@query(
    _WITH_GAPS + "SELECT * FROM gaps WHERE brand IS NOT NULL AND kind IS NOT NULL "
    "AND size IS NOT NULL AND p_partkey IS NOT NULL"
)
def drop_incomplete(t: Tables) -> DataFrame:
    return op.drop_incomplete(_part_with_gaps(t))


@query(
    _WITH_GAPS + "SELECT count(*) AS rows_before, "
    "count(*) FILTER (WHERE brand IS NOT NULL AND kind IS NOT NULL AND size IS NOT NULL) "
    "AS rows_after, CAST(4 AS INTEGER) AS n_cols FROM gaps"
)
def completeness_report(t: Tables) -> DataFrame:
    return op.completeness_report(_part_with_gaps(t))


@query(
    _WITH_GAPS + "SELECT p_partkey, coalesce(brand, '0.0') AS brand, kind, "
    "coalesce(size, 0) AS size FROM gaps"
)
def fill_const(t: Tables) -> DataFrame:
    return op.fill_const(_part_with_gaps(t), {"brand": "0.0", "size": 0})


@query(
    _WITH_GAPS + "SELECT p_partkey IS NULL AS p_partkey, brand IS NULL AS brand, "
    "kind IS NULL AS kind, size IS NULL AS size FROM gaps"
)
def null_flags(t: Tables) -> DataFrame:
    return op.null_flags(_part_with_gaps(t))


@query(
    "SELECT p_partkey, CAST(0 AS INTEGER) AS from_brand, "
    "CAST(substr(p_brand, 7) AS INTEGER) AS from_tail, "
    "CAST(trunc(p_retailprice) AS INTEGER) AS from_price FROM part"
)
def coerce_to_int(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        coerce_int("p_brand").alias("from_brand"),
        coerce_int(F.substring("p_brand", 7, 10)).alias("from_tail"),
        coerce_int("p_retailprice").alias("from_price"),
    )


# ---- counts and rankings ----------------------------------------------------------


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def per_year_count(t: Tables) -> DataFrame:
    return op.count_by(op.time_parts(t.orders, "o_orderdate", "year"), "year").orderBy("year")


@query("SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_cols FROM orders")
def shape(t: Tables) -> DataFrame:
    return op.shape(t.orders)


@query("SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def distinct_count(t: Tables) -> DataFrame:
    return op.distinct_count(t.lineitem, "l_partkey")


@query("SELECT DISTINCT nullif(p_brand, 'Brand#7') AS brand FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return op.distinct_values(_part_with_gaps(t), "brand")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(t: Tables) -> DataFrame:
    return op.count_by(t.events, "event_type").orderBy(F.desc("n"))


@query(
    "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer "
    "GROUP BY c_nationkey, c_mktsegment"
)
def two_key_counts(t: Tables) -> DataFrame:
    return op.count_by(t.customer, "c_nationkey", "c_mktsegment")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10")
def top_n_keys(t: Tables) -> DataFrame:
    return op.top_n(t.part, "p_name", 10)


@query(
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey "
    "ORDER BY n DESC, l_suppkey LIMIT 20"
)
def top_n_ascending(t: Tables) -> DataFrame:
    return op.top_n(t.lineitem, "l_suppkey", 20, ascending_output=True)


@query(
    "SELECT o_orderpriority, count(*) AS n, "
    "round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct "
    "FROM orders GROUP BY o_orderpriority"
)
def share_of_total(t: Tables) -> DataFrame:
    return rounded(op.share_of_total(t.orders, "o_orderpriority"), "pct")


@query(
    "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) "
    "SELECT c_nationkey, n, round((SELECT avg(n) FROM c), 6) AS mean_n FROM c"
)
def count_vs_mean(t: Tables) -> DataFrame:
    return rounded(op.count_vs_mean(t.customer, "c_nationkey"), "mean_n")


# ---- flags ---------------------------------------------------------------------------


@query(
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_flag "
    "FROM orders GROUP BY o_orderpriority"
)
def flag_count(t: Tables) -> DataFrame:
    counted = op.flag_count(t.orders, "o_orderpriority", "o_orderstatus", "F")
    return counted.orderBy(F.desc("n_flag"))


@query(
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_flag, "
    "count(*) AS n, "
    "round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 6) AS pct "
    "FROM orders GROUP BY o_orderpriority"
)
def flag_rate(t: Tables) -> DataFrame:
    return rounded(op.flag_rate(t.orders, "o_orderpriority", "o_orderstatus", "F"), "pct")


_TREND = (
    "WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, "
    "nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, "
    "nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O FROM orders GROUP BY 1) "
)


@query(_TREND + "SELECT year, F, O FROM p")
def flag_pivot(t: Tables) -> DataFrame:
    dated = op.time_parts(t.orders, "o_orderdate", "year")
    return op.flag_pivot(dated, "year", "o_orderstatus", ["F", "O"])


@query(_TREND + "SELECT year, F, O, F + O AS total, round(F * 100.0 / (F + O), 6) AS pct FROM p")
def flag_trend(t: Tables) -> DataFrame:
    dated = op.time_parts(t.orders, "o_orderdate", "year")
    return rounded(op.flag_trend(dated, "year", "o_orderstatus", ["F", "O"]), "pct")


@query(
    "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code, "
    "coalesce(n_name, '') AS area_name FROM customer "
    "LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 4) k ON c_nationkey = n_nationkey"
)
def area_lookup_join(t: Tables) -> DataFrame:
    lookup = t.nation.filter("n_nationkey <> 4").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")
    )
    coded = t.customer.select(
        "c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code")
    )
    return op.enrich_lookup(coded, "code", lookup)


@query(
    "SELECT n_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_a, "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS n_b, "
    "round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 6) AS pct_a "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "WHERE o_orderstatus IN ('F', 'O') GROUP BY n_name"
)
def area_flag_rates(t: Tables) -> DataFrame:
    # Orders are counted per customer first, so the joins see counts instead of rows.
    counts = op.count_by(
        t.orders.filter(F.col("o_orderstatus").isin("F", "O")), "o_custkey", "o_orderstatus"
    )
    joined = (
        counts.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "o_orderstatus", "n")
    )
    rates = op.outer_counts(joined, "n_name", "o_orderstatus", "F", "O", weight="n")
    return rounded(rates, "pct_a")


# ---- top items per group -----------------------------------------------------------------

_YEAR_COUNTS = (
    "WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, "
    "count(*) AS n FROM orders GROUP BY 1, 2) "
)
_YEAR_RANKS = (
    _YEAR_COUNTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY year "
    "ORDER BY n DESC, o_orderpriority DESC) AS rank FROM c) "
)


@query(
    _YEAR_COUNTS + "SELECT c.year, o_orderpriority, n FROM c "
    "JOIN (SELECT year, max(n) AS m FROM c GROUP BY year) m ON c.year = m.year AND n = m"
)
def argmax_per_year(t: Tables) -> DataFrame:
    dated = op.time_parts(t.orders, "o_orderdate", "year")
    return op.argmax_per_group(dated, "year", "o_orderpriority")


@query(_YEAR_RANKS + "SELECT year, o_orderpriority, n FROM r WHERE rank <= 3")
def top3_per_year(t: Tables) -> DataFrame:
    dated = op.time_parts(t.orders, "o_orderdate", "year")
    top = op.top_k_per_group(dated, "year", "o_orderpriority", 3)
    return top.orderBy("year", F.desc("n"))


@query(
    _YEAR_RANKS + "SELECT year, "
    + ", ".join(
        f"max(o_orderpriority) FILTER (WHERE rank = {i}) AS item_{i}, "
        f"max(n) FILTER (WHERE rank = {i}) AS n_{i}"
        for i in (1, 2, 3)
    )
    + " FROM r GROUP BY year"
)
def top3_columns(t: Tables) -> DataFrame:
    dated = op.time_parts(t.orders, "o_orderdate", "year")
    tops = op.top_k_columns(dated, "year", "o_orderpriority", 3)
    flat = [
        c
        for i in (1, 2, 3)
        for c in (
            F.col(f"top_{i}.o_orderpriority").alias(f"item_{i}"),
            F.col(f"top_{i}.n").alias(f"n_{i}"),
        )
    ]
    return tops.select("year", *flat)


@query(
    "WITH k AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 20) "
    "SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE 'OTHER' END "
    "AS p_name FROM part"
)
def bucket_other(t: Tables) -> DataFrame:
    return op.bucket_other(t.part.select("p_partkey", "p_name"), "p_name", keep=20)


# ---- calendar --------------------------------------------------------------------------


@query(
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, "
    "CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, "
    "CAST(isodow(ts) - 1 AS INTEGER) AS weekday, strftime(ts, '%Y-%m-%d') AS date, "
    "strftime(ts, '%H:%M:%S') AS time, dayname(ts) AS weekday_name FROM events"
)
def time_parts(t: Tables) -> DataFrame:
    return dates_as_text(op.time_parts(t.events.select("event_id", "ts"), "ts").drop("ts"), "date")


_STAMPS = (
    "WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '2020-13-45' "
    "ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS stamp FROM events) "
)


@query(
    _STAMPS + "SELECT event_id, stamp, "
    "strftime(try_strptime(stamp, '%m/%d/%Y %I:%M:%S %p'), '%Y-%m-%d %H:%M:%S') AS text, "
    "CAST(year(try_strptime(stamp, '%m/%d/%Y %I:%M:%S %p')) AS INTEGER) AS year FROM s"
)
def parse_timestamps(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "2020-13-45").otherwise(
        format_ts("ts", "MM/dd/yyyy hh:mm:ss a")
    )
    stamps = t.events.select("event_id", text.alias("stamp"))
    parsed = stamps.withColumn("ts", parse_ts("stamp"))
    return parsed.select("event_id", "stamp", format_ts("ts").alias("text"), part("year", "ts"))


@query(
    "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n "
    "FROM orders WHERE month(o_orderdate) NOT IN (2, 3, 8) GROUP BY 1), "
    "m AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM c)::TIMESTAMP, "
    "(SELECT max(month) FROM c)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month) "
    "SELECT strftime(m.month, '%Y-%m-%d') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN c ON m.month = c.month"
)
def monthly_counts(t: Tables) -> DataFrame:
    with_gaps = t.orders.filter(~F.month("o_orderdate").isin(2, 3, 8))
    return dates_as_text(op.monthly_counts(with_gaps, "o_orderdate").orderBy("month"), "month")


@query(
    "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, count(*) AS n FROM events GROUP BY 1"
)
def count_by_weekday(t: Tables) -> DataFrame:
    return op.count_by_weekday(t.events, "ts")


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1")
def count_by_month(t: Tables) -> DataFrame:
    return op.count_by_month(t.orders, "o_orderdate")


# ---- matrices --------------------------------------------------------------------------


def _dense_sql(row: str, col: str, n_cols: int, table: str) -> str:
    """A CTE `d` with all columns 0 .. n_cols-1 for every row key."""
    return (
        f"WITH c AS (SELECT {row} AS row_key, CAST({col} AS INTEGER) AS col_key, count(*) AS n "
        f"FROM {table} GROUP BY 1, 2), d AS (SELECT r.row_key, k.col_key, coalesce(n, 0) AS n "
        "FROM (SELECT DISTINCT row_key FROM c) r CROSS JOIN "
        f"(SELECT CAST(range AS INTEGER) AS col_key FROM range({n_cols})) k "
        "LEFT JOIN c ON c.row_key = r.row_key AND c.col_key = k.col_key) "
    )


_HOURS_SQL = _dense_sql("event_type", "hour(ts)", 24, "events")
_WEEK_SQL = _dense_sql("event_type", "isodow(ts) - 1", 7, "events")


@query(_HOURS_SQL + "SELECT * FROM d")
def hour_by_type(t: Tables) -> DataFrame:
    return op.hour_by(t.events, "ts", "event_type")


@query("SELECT user_id AS row_key, CAST(hour(ts) AS INTEGER) AS col_key, count(*) AS n "
       "FROM events GROUP BY 1, 2")
def hour_by_user(t: Tables) -> DataFrame:
    return op.hour_by(t.events, "ts", "user_id", dense=False)


@query(
    "SELECT event_type AS row_key, "
    + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS c_{h}" for h in range(24))
    + " FROM events GROUP BY event_type"
)
def hour_by_type_wide(t: Tables) -> DataFrame:
    return op.crosstab_wide(t.events, "event_type", part("hour", "ts"), HOURS)


@query(_WEEK_SQL + "SELECT * FROM d")
def weekday_by_type(t: Tables) -> DataFrame:
    return op.weekday_by(t.events, "ts", "event_type")


@query(
    _dense_sql("user_id", "isodow(ts) - 1", 7, "events") + "SELECT * FROM d"
)
def weekday_by_user(t: Tables) -> DataFrame:
    return op.weekday_by(t.events, "ts", "user_id")


@query(
    _dense_sql("CAST(isodow(ts) - 1 AS INTEGER)", "hour(ts)", 24, "events")
    + "SELECT row_key AS weekday, "
    "dayname(DATE '2024-01-01' + row_key) AS row_key, col_key, n FROM d"
)
def weekday_by_hour(t: Tables) -> DataFrame:
    return op.weekday_by_hour(t.events, "ts")


_BRAND_TYPE = "SELECT p_brand AS row_key, p_type AS col_key, count(*) AS n FROM part GROUP BY 1, 2"


@query(_BRAND_TYPE)
def key_by_key(t: Tables) -> DataFrame:
    return op.crosstab(t.part, "p_brand", "p_type")


@query(f"SELECT col_key AS row_key, row_key AS col_key, n FROM ({_BRAND_TYPE}) x")
def transposed(t: Tables) -> DataFrame:
    return op.transpose(op.crosstab(t.part, "p_brand", "p_type"))


@query(f"SELECT col_key, CAST(sum(n) AS BIGINT) AS n FROM ({_BRAND_TYPE}) x GROUP BY col_key")
def column_totals(t: Tables) -> DataFrame:
    return op.column_totals(op.crosstab(t.part, "p_brand", "p_type"), "col_key")


_DAILY = (
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS row_key, o_orderstatus AS col_key, count(*) AS n "
    "FROM orders GROUP BY 1, 2"
)
_ALL_DAYS = (
    f"WITH c AS ({_DAILY}), d AS (SELECT a.row_key, b.col_key, coalesce(n, 0) AS n FROM "
    "(SELECT DISTINCT row_key FROM c) a CROSS JOIN (SELECT DISTINCT col_key FROM c) b "
    "LEFT JOIN c ON c.row_key = a.row_key AND c.col_key = b.col_key) "
)


@query(_DAILY)
def daily_type_counts(t: Tables) -> DataFrame:
    return dates_as_text(op.daily_counts(t.orders, "o_orderdate", "o_orderstatus"), "row_key")


@query(
    _ALL_DAYS + "SELECT row_key, col_key, n, CASE WHEN count(n) OVER w >= 365 "
    "THEN CAST(sum(n) OVER w AS BIGINT) END AS rolling FROM d WINDOW w AS "
    "(PARTITION BY col_key ORDER BY row_key ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)"
)
def rolling_365(t: Tables) -> DataFrame:
    daily = op.daily_counts(t.orders, "o_orderdate", "o_orderstatus")
    return dates_as_text(op.rolling_on_all_days(daily, 365), "row_key")


_Z = (
    ", z AS (SELECT *, (n - avg(n) OVER (PARTITION BY row_key)) / "
    "stddev_samp(n) OVER (PARTITION BY row_key) AS z FROM d) "
)


@query(_HOURS_SQL + _Z + "SELECT row_key, col_key, n, round(z, 6) AS z FROM z")
def zscore_rows(t: Tables) -> DataFrame:
    return rounded(op.zscore_within(op.hour_by(t.events, "ts", "event_type")), "z")


@query(
    _WEEK_SQL + _Z + ", cap AS (SELECT least(max(z), abs(min(z))) AS cap FROM z) "
    "SELECT row_key, col_key, n, "
    "round(greatest(least(z, (SELECT cap FROM cap)), -(SELECT cap FROM cap)), 6) AS z FROM z"
)
def clip_symmetric(t: Tables) -> DataFrame:
    cells = op.zscore_within(op.weekday_by(t.events, "ts", "event_type"))
    return rounded(op.clip_symmetric(cells), "z")


@query(
    f"SELECT *, round(coalesce((n - lo) / nullif(hi - lo, 0)::DOUBLE, 0.0), 6) AS scaled FROM "
    "(SELECT row_key, col_key, n FROM (" + _BRAND_TYPE + ") x) a JOIN "
    "(SELECT col_key AS ck, min(n) AS lo, max(n) AS hi FROM (" + _BRAND_TYPE + ") y GROUP BY 1) b "
    "ON col_key = ck"
)
def minmax_cols(t: Tables) -> DataFrame:
    cells = op.crosstab(t.part, "p_brand", "p_type")
    edges = cells.groupBy(F.col("col_key").alias("ck")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    scaled = rounded(op.minmax_within(cells), "scaled")
    return scaled.join(edges, F.col("col_key") == F.col("ck"))


@query(
    "WITH c AS (SELECT p_brand AS row_key, p_name AS col_key, count(*) AS n FROM part "
    "GROUP BY 1, 2), k AS (SELECT col_key FROM c GROUP BY col_key "
    "ORDER BY sum(n) DESC, col_key LIMIT 10), "
    "d AS (SELECT r.row_key, k.col_key, coalesce(n, 0) AS n FROM "
    "(SELECT DISTINCT row_key FROM c) r CROSS JOIN k "
    "LEFT JOIN c ON c.row_key = r.row_key AND c.col_key = k.col_key) "
    "SELECT row_key, col_key, n, round(coalesce((n - min(n) OVER (PARTITION BY row_key)) / "
    "nullif(max(n) OVER (PARTITION BY row_key) - min(n) OVER (PARTITION BY row_key), 0)::DOUBLE, "
    "0.0), 6) AS scaled FROM d"
)
def top_types_matrix(t: Tables) -> DataFrame:
    return rounded(op.top_columns_matrix(t.part, "p_brand", "p_name", 10), "scaled")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN "
    "round(l_tax / l_discount, 6) ELSE 0.0 END AS ratio FROM lineitem"
)
def finite_ratio(t: Tables) -> DataFrame:
    ratio = F.try_divide(F.col("l_tax"), F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(finite_or_zero(ratio), 6).alias("ratio"),
    )


# ---- locations -------------------------------------------------------------------------


def _with_point(t: Tables) -> DataFrame:
    text = F.when(F.col("l_linenumber") == 7, F.lit("0.0")).otherwise(
        F.concat(
            F.lit("("),
            F.col("l_suppkey").cast("string"),
            F.lit(".5, -"),
            F.col("l_linenumber").cast("string"),
            F.lit(".25)"),
        )
    )
    return t.lineitem.select("l_orderkey", "l_partkey", text.alias("location"))


_POINT_SQL = (
    "WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 "
    "THEN '0.0' ELSE concat('(', CAST(l_suppkey AS VARCHAR), '.5, -', "
    "CAST(l_linenumber AS VARCHAR), '.25)') END AS location FROM lineitem) "
)


@query(
    _POINT_SQL + "SELECT l_orderkey, l_partkey, location, "
    "CASE WHEN l_linenumber < 7 THEN l_suppkey + 0.5::DOUBLE END AS lat, "
    "CASE WHEN l_linenumber < 7 THEN -l_linenumber - 0.25::DOUBLE END AS long FROM p"
)
def parse_points(t: Tables) -> DataFrame:
    points = _with_point(t).withColumn("point", parse_point("location"))
    return points.select("l_orderkey", "l_partkey", "location", "point.lat", "point.long")


@query(
    _POINT_SQL + "SELECT l_suppkey + 0.5::DOUBLE AS lat, -l_linenumber - 0.25::DOUBLE AS long, n, "
    "round(n / 45.0, 6) AS radius, n > 80 AS is_hot FROM (SELECT location, l_suppkey, "
    "l_linenumber, count(*) AS n FROM p WHERE l_linenumber < 7 GROUP BY 1, 2, 3 "
    "ORDER BY n DESC, location LIMIT 100) x"
)
def hotspots(t: Tables) -> DataFrame:
    return rounded(op.hotspots(_with_point(t), "location", n=100, hot=80), "radius")
