"""Profiles of numeric and text columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter import operators as op
from checks.registry import Tables, query, rounded

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, cols: list[str]) -> str:
    return " UNION ALL ".join(template.replace("$c", c) for c in cols)


_GAPPY = (
    "WITH gaps AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand, "
    "nullif(p_size, 10) AS size FROM part) "
)
_KINDS = {"p_partkey": "bigint", "brand": "string", "size": "int"}


@query(
    _GAPPY
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM gaps"
        for c, kind in _KINDS.items()
    )
)
def profile_nulls(t: Tables) -> DataFrame:
    gaps = t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#7")).alias("brand"),
        F.nullif("p_size", F.lit(10)).alias("size"),
    )
    return rounded(op.profile(gaps), "null_pct")


@query(
    "SELECT \"column\", stat, round(value, 6) AS value FROM ("
    + _union(
        " UNION ALL ".join(
            f"SELECT '$c' AS \"column\", '{stat}' AS stat, CAST({e} AS DOUBLE) AS value "
            "FROM lineitem"
            for stat, e in {
                "count": "count($c)",
                "mean": "avg($c)",
                "std": "stddev_samp($c)",
                "min": "min($c)",
                "25%": "quantile_cont($c, 0.25)",
                "50%": "quantile_cont($c, 0.5)",
                "75%": "quantile_cont($c, 0.75)",
                "max": "max($c)",
            }.items()
        ),
        _MEASURES,
    )
    + ") x"
)
def describe(t: Tables) -> DataFrame:
    return rounded(op.describe(t.lineitem, _MEASURES), "value")


def _histogram_sql(cols: list[str], bins: str) -> str:
    """`bins` is an expression over n, span and iqr."""
    one = (
        "SELECT '$c' AS \"column\", b.bin, round(lo + b.bin * width, 6) AS lo, "
        "round(lo + (b.bin + 1) * width, 6) AS hi, coalesce(n, 0) AS n FROM "
        "(SELECT lo, span / bins AS width, bins FROM (SELECT lo, span, "
        f"CAST({bins} AS BIGINT) AS bins FROM (SELECT min($c) AS lo, max($c) - min($c) AS span, "
        "count($c) AS n, quantile_cont($c, 0.75) - quantile_cont($c, 0.25) AS iqr "
        "FROM lineitem) s) e) e, "
        "LATERAL (SELECT CAST(unnest(range(e.bins)) AS INTEGER) AS bin) b LEFT JOIN "
        "(SELECT least(floor(($c - lo) / (span / bins)), bins - 1) AS bin, count(*) AS n "
        "FROM lineitem, (SELECT lo, span, "
        f"CAST({bins} AS BIGINT) AS bins FROM (SELECT min($c) AS lo, max($c) - min($c) AS span, "
        "count($c) AS n, quantile_cont($c, 0.75) - quantile_cont($c, 0.25) AS iqr "
        "FROM lineitem) s) e GROUP BY 1) c ON c.bin = b.bin"
    )
    return _union(one, cols)


@query(_histogram_sql(_MEASURES, "10"))
def histogram(t: Tables) -> DataFrame:
    return rounded(op.histogram(t.lineitem, _MEASURES), "lo", "hi")


@query(
    _histogram_sql(
        ["l_extendedprice", "l_quantity"],
        "ceil(span / least(span / (log2(n) + 1), iqr * 2 / cbrt(n)))",
    )
)
def histogram_auto(t: Tables) -> DataFrame:
    bins = op.histogram(t.lineitem, ["l_extendedprice", "l_quantity"], bins="auto")
    return rounded(bins, "lo", "hi")


@query(
    "WITH s AS (SELECT count(*)::DOUBLE AS n, min(p_size)::DOUBLE AS lo, "
    "max(p_size)::DOUBLE AS hi, stddev_samp(p_size) * pow(count(*)::DOUBLE, -0.2) AS h "
    "FROM part), g AS (SELECT lo + range * ((hi - lo) / 199) AS x FROM range(200), s) "
    "SELECT round(x, 6) AS x, round(sum(exp(-0.5 * ((x - p_size) / h) * ((x - p_size) / h))) / "
    "(max(n) * max(h) * sqrt(2 * pi())), 9) AS density FROM g, part, s GROUP BY x"
)
def density(t: Tables) -> DataFrame:
    return rounded(rounded(op.density(t.part, "p_size"), "x"), "density", digits=9)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for a in _CORR_COLS
        for b in _CORR_COLS
    )
)
def corr_matrix(t: Tables) -> DataFrame:
    return rounded(op.corr_matrix(t.lineitem, _CORR_COLS), "r")
