import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter import operators as op
from blotter.functions import coerce_int, finite_or_zero, format_ts, parse_point, parse_ts, pct
from blotter.operators.ordered import _sliced


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---- functions -------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01/01/2020 12:00:00 AM", "2020-01-01 00:00:00"),
        ("01/01/2020 12:00:00 PM", "2020-01-01 12:00:00"),
        ("12/31/2019 11:59:59 PM", "2019-12-31 23:59:59"),
        ("2020-13-45", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_ts(table, text, expected):
    df = table([(text,)], "s string").select(format_ts(parse_ts("s")).alias("t"))
    assert values(df, "t") == [(expected,)]


@pytest.mark.parametrize(
    "text, expected",
    [("abc", 0), ("7.9", 7), ("-7.9", -7), ("", 0), (None, 0), ("7d", 0), (" 12 ", 12),
     ("1e3", 1000), ("99999999999", 0), ("NaN", 0)],
)
def test_coerce_int(table, text, expected):
    assert values(table([(text,)], "s string").select(coerce_int("s").alias("i")), "i") == [
        (expected,)
    ]


@pytest.mark.parametrize(
    "text, expected",
    [("0.0", None), ("", None), (None, None), ("(41.8, -87.6)", (41.8, -87.6)),
     ("(41.8,-87.6)", (41.8, -87.6)), ("(a, 1)", None), ("()", None), ("(1)", None)],
)
def test_parse_point(table, text, expected):
    ((got,),) = values(table([(text,)], "s string").select(parse_point("s").alias("p")), "p")
    assert (got and tuple(got)) == expected


def test_pct_and_finite(table):
    df = table([(1, 4, math.inf), (1, 0, math.nan), (None, 2, None)], "a int, b int, c double")
    got = values(df.select(pct("a", "b").alias("p"), finite_or_zero("c").alias("f")), "p", "f")
    assert got == [(25.0, 0.0), (None, 0.0), (None, 0.0)]


# ---- cleaning ----------------------------------------------------------------------


def test_clean_helpers(table):
    df = table([(1, None, "x"), (2, 3.0, None)], "`A B` int, c double, d string")
    named = op.normalize_names(df)
    assert named.columns == ["A_B", "c", "d"]
    assert op.normalize_names(named).columns == named.columns
    assert op.require_not_null(named, ["c", "A_B"]).count() == 1
    assert op.drop_incomplete(named).count() == 0
    assert values(op.completeness_report(named), "rows_before", "rows_after", "n_cols") == [
        (2, 0, 3)
    ]
    assert values(op.fill_const(named, {"c": 0.0, "d": "0.0"}), "c", "d") == [
        (0.0, "x"),
        (3.0, "0.0"),
    ]
    assert op.columns_of_type(named, T.StringType) == ["d"]
    features, label = op.features_label(named, "d", exclude=["c"])
    assert (features.columns, label.columns) == (["A_B"], ["d"])
    assert values(op.null_flags(named), "c", "d") == [(True, False), (False, True)]


def test_names_ignore_case(table):
    df = table([("t",)], "Primary_Type string")
    assert op.distinct_count(df, "Primary_type").first()[0] == 1


# ---- counts and ranks --------------------------------------------------------------


def test_distinct_counts_null_once(table):
    df = table([("a",), (None,), (None,), ("b",)], "k string")
    assert op.distinct_count(df, "k").first()[0] == 3
    assert op.distinct_count(df, "k", approximate=True).first()[0] == 3
    assert op.distinct_values(df, "k").count() == 3


def test_top_n_orders_ties_by_value(table):
    df = table([(k,) for k in "ccbbad"], "k string")
    assert values(op.top_n(df, "k", 3), "k", "n") == [("b", 2), ("c", 2), ("a", 1)]
    assert values(op.top_n(df, "k", 3, True), "k") == [("a",), ("c",), ("b",)]


def test_share_sums_to_100(table):
    df = table([(k,) for k in "aabc"], "k string")
    shares = dict(values(op.share_of_total(df, "k"), "k", "pct"))
    assert shares == {"a": 50.0, "b": 25.0, "c": 25.0}
    assert {m for (m,) in values(op.count_vs_mean(df, "k"), "mean_n")} == {4 / 3}


def test_argmax_keeps_ties_and_top3_breaks_them(table):
    rows = [(2020, t) for t in "aabbccd"] + [(2021, "x"), (2021, "y"), (2021, "y")]
    df = table(rows, "year int, type string")
    best = values(op.argmax_per_group(df, "year", "type").orderBy("year", "type"), "year", "type")
    assert best == [(2020, "a"), (2020, "b"), (2020, "c"), (2021, "y")]
    top = values(
        op.top_k_per_group(df, "year", "type", 3, keep_rank=True).orderBy("year", "rank"),
        "year", "type",
    )
    assert top == [(2020, "c"), (2020, "b"), (2020, "a"), (2021, "y"), (2021, "x")]
    wide = {r.year: r for r in op.top_k_columns(df, "year", "type", 3).collect()}
    assert tuple(wide[2020].top_1) == (2, "c")
    assert tuple(wide[2021].top_2) == (1, "x") and wide[2021].top_3 is None


def test_ranks_are_limited_before_the_shuffle(table):
    df = table([(1, "a")], "g int, i string")
    for result in (op.argmax_per_group(df, "g", "i"), op.top_k_per_group(df, "g", "i")):
        assert "WindowGroupLimit" in result._jdf.queryExecution().executedPlan().toString()


def test_bucket_other(table):
    df = table([(k,) for k in ["a", "a", "c", "b", None, "d"]], "k string")
    got = sorted(str(k) for (k,) in values(op.bucket_other(df, "k", keep=2), "k"))
    assert got == ["None", "OTHER", "OTHER", "a", "a", "b"]


# ---- flags -----------------------------------------------------------------------------


def test_flag_trend_with_a_missing_value(table):
    df = table([(1, "true"), (1, "false"), (2, "true"), (3, "other")], "y int, f string")
    got = values(op.flag_trend(df, "y", "f"), "y", "true", "false", "total", "pct")
    assert got == [(1, 1, 1, 2, 50.0), (2, 1, None, None, None), (3, None, None, None, None)]
    filled = values(op.flag_trend(df, "y", "f", fill_zero=True), "total", "pct")
    assert filled == [(2, 50.0), (1, 100.0), (0, None)]


def test_flag_counts(table):
    df = table([("a", "true"), ("a", "false"), ("b", "false"), ("b", None)], "k string, f string")
    assert set(values(op.flag_count(df, "k", "f"), "k", "n_flag")) == {("a", 1), ("b", 0)}
    assert set(values(op.flag_rate(df, "k", "f"), "k", "n", "pct")) == {("a", 2, 50.0), ("b", 2, 0.0)}


def test_outer_counts_equal_the_join_form(table):
    df = table(
        [("a", "true"), ("a", "false"), ("b", "false"), ("c", "?"), ("d", "true"), ("d", None)],
        "k string, f string",
    )
    a = df.filter("f = 'true'").groupBy("k").agg(F.count("f").alias("n_a"))
    b = df.filter("f = 'false'").groupBy("k").agg(F.count("f").alias("n_b"))
    joined = a.join(b, "k", "outer").fillna(0)
    assert set(values(op.outer_counts(df, "k", "f"), "k", "n_a", "n_b")) == set(
        values(joined, "k", "n_a", "n_b")
    )


def test_enrich_lookup(table):
    lookup = table([(8, "Near"), (9, "Far")], "code int, name string")
    df = table([("8",), ("08",), ("99",), (None,), ("x",)], "area string")
    names = dict(values(op.enrich_lookup(df, "area", lookup), "area", "area_name"))
    assert names == {"8": "Near", "08": "Near", "99": "", None: "", "x": ""}
    assert op.enrich_lookup(df, "area", lookup, drop_unknown=True).count() == 2


# ---- calendar and matrices -------------------------------------------------------------------


def stamps(table, *texts):
    return table([(t,) for t in texts], "s string").select(F.to_timestamp("s").alias("ts"))


def test_time_parts(table):
    df = op.time_parts(stamps(table, "2024-01-01 06:35:15"), "ts")
    row = df.first()
    assert (row.year, row.month, row.day, row.hour) == (2024, 1, 1, 6)
    assert (row.weekday, row.weekday_name, row.time) == (0, "Monday", "06:35:15")
    assert row.date == dt.date(2024, 1, 1)


def test_months_without_rows_count_zero(table):
    df = stamps(table, "2020-01-31 10:00:00", "2020-04-30 00:00:00", "2020-04-01 00:00:00")
    got = values(op.monthly_counts(df, "ts").orderBy("month"), "month", "n")
    assert [(m.month, n) for m, n in got] == [(1, 1), (2, 0), (3, 0), (4, 2)]
    assert op.monthly_counts(df, "ts", fill=False).count() == 2


def test_crosstab_forms_agree(table):
    df = table([("a", 0), ("a", 2), ("a", 2), ("b", 1), (None, 1)], "k string, c int")
    sparse = {(r, c): n for r, c, n in values(op.crosstab(df, "k", "c"), "row_key", "col_key", "n")}
    dense = values(op.crosstab_dense(df, "k", "c", [0, 1, 2]), "row_key", "col_key", "n")
    assert sum(sparse.values()) == 4 and len(dense) == 6
    assert {(r, c): n for r, c, n in dense if n} == sparse
    wide = {r.row_key: (r.c_0, r.c_1, r.c_2) for r in op.crosstab_wide(df, "k", "c", [0, 1, 2]).collect()}
    assert wide == {"a": (1, 0, 2), "b": (0, 1, 0)}
    back = op.transpose(op.transpose(op.crosstab(df, "k", "c")))
    assert set(values(back, "row_key", "col_key")) == set(sparse)
    assert dict(values(op.column_totals(op.crosstab(df, "k", "c"), "col_key"), "col_key", "n")) == {0: 1, 1: 1, 2: 2}


def test_week_is_listed_from_monday(table):
    df = stamps(table, "2024-01-01 06:00:00", "2024-01-07 07:00:00")
    cells = op.weekday_by_hour(df, "ts")
    names = dict(values(cells, "weekday", "row_key"))
    assert names == {0: "Monday", 6: "Sunday"}
    assert cells.count() == 48


def test_zscore_minmax_clip(table):
    cells = table(
        [("a", 0, 1), ("a", 1, 2), ("a", 2, 6), ("b", 0, 4), ("b", 1, 4), ("b", 2, 4)],
        "row_key string, col_key int, n bigint",
    )
    z = op.zscore_within(cells)
    rows = [v for k, v in values(z, "row_key", "z") if k == "a"]
    assert abs(sum(rows)) < 1e-9 and abs(np.std(rows, ddof=1) - 1) < 1e-9
    assert {v for k, v in values(z, "row_key", "z") if k == "b"} == {None}
    cap = min(max(rows), abs(min(rows)))
    clipped = [v for k, v in values(op.clip_symmetric(z), "row_key", "z") if k == "a"]
    assert np.allclose(sorted(clipped), sorted(np.clip(rows, -cap, cap)))
    scaled = {(r, c): v for r, c, v in values(op.minmax_within(cells), "row_key", "col_key", "scaled")}
    assert scaled[("a", 0)] == 0.0 and scaled[("b", 0)] == 1.0
    flat = op.minmax_within(cells, "row_key")
    assert {v for k, v in values(flat, "row_key", "scaled") if k == "b"} == {0.0}


def test_top_columns_matrix(table):
    rows = [("p", "x")] * 3 + [("p", "y")] * 2 + [("q", "y")] * 2 + [("r", "z")]
    got = {
        (r, c): (n, s)
        for r, c, n, s in values(
            op.top_columns_matrix(table(rows, "place string, type string"), "place", "type", 2),
            "row_key", "col_key", "n", "scaled",
        )
    }
    assert got == {
        ("p", "x"): (3, 1.0), ("p", "y"): (2, 0.0),
        ("q", "x"): (0, 0.0), ("q", "y"): (2, 1.0),
        ("r", "x"): (0, 0.0), ("r", "y"): (0, 0.0),
    }


def test_rolling_sum_needs_a_full_frame(table):
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=i), "t", 1) for i in range(366)]
    daily = table(rows, "row_key date, col_key string, n int")
    got = values(op.rolling_sum(daily, "row_key", "n", 365, ["col_key"]).orderBy("row_key"), "rolling")
    assert [r for (r,) in got] == [None] * 364 + [365, 365]
    early = op.rolling_sum(daily, "row_key", "n", 3, ["col_key"], min_periods=1).orderBy("row_key")
    assert [r for (r,) in values(early.limit(4), "rolling")] == [1, 2, 3, 3]


def test_absent_days_are_zero_for_every_type(table):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 5)]
    daily = table([(days[0], "a", 2), (days[1], "b", 1)], "row_key date, col_key string, n bigint")
    assert set(values(op.on_all_days(daily), "row_key", "col_key", "n")) == {
        (days[0], "a", 2), (days[0], "b", 0), (days[1], "a", 0), (days[1], "b", 1)
    }


def test_hotspots(table):
    rows = [("(1.0, 2.0)",)] * 3 + [("(3.0, 4.0)",)] * 2 + [("0.0",)] * 5 + [(None,)]
    got = op.hotspots(table(rows, "loc string"), "loc", n=5, scale=2, hot=2).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 3, 1.5, True), (3.0, 4.0, 2, 1.0, False)]


# ---- order statistics and profiles ------------------------------------------------------------


@pytest.mark.parametrize("days", [1, 3, 50])
@pytest.mark.parametrize("kind", ["string", "int"])
def test_rolling_runs_add_up_like_a_dense_frame(table, days, kind):
    rng = np.random.default_rng(days)
    data = {}
    for _ in range(300):
        day = int(rng.choice([0, 1, 2, 30, 31, 40, 41, 42, 43, 60]))
        key = (int(rng.integers(0, 5)) ** 2)
        data[day, key] = data.get((day, key), 0) + 1
    data[7, 99] = 1
    rows = [(d, str(k) if kind == "string" else k, n) for (d, k), n in data.items()]
    daily = table(rows, f"row_key int, col_key {kind}, n long")
    found = {(d, k): (n, r) for d, k, n, r in values(op.rolling_on_all_days(daily, days), "row_key", "col_key", "n", "rolling")}
    dense = op.rolling_sum(op.on_all_days(daily), "row_key", "n", days, ["col_key"])
    assert found == {(d, k): (n, r) for d, k, n, r in values(dense, "row_key", "col_key", "n", "rolling")}
    runs, _ = op.rolling_runs(daily, days)
    assert runs.count() <= 2 * len(data) + 6
    assert op.rolling_on_all_days(daily.filter("false"), days).count() == 0


@pytest.mark.parametrize("digits, few", [(16, 3), (1024, 100_000)])
def test_exact_quantiles(table, digits, few):
    rng = np.random.default_rng(5)
    data = {
        "even": rng.uniform(0, 1, 4000),
        "hot": np.where(rng.uniform(0, 1, 4000) < 0.4, 7.0, rng.normal(0, 50, 4000)),
        "few": rng.integers(0, 3, 4000).astype(float),
        "flat": np.full(4000, 2.5),
    }
    df = table(list(zip(*[map(float, v) for v in data.values()])), ", ".join(f"{c} double" for c in data))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    for column, prob, value in values(
        op.exact_quantiles(df, list(data), probs, digits, few), "column", "prob", "value"
    ):
        assert value == pytest.approx(np.quantile(data[column], prob), abs=1e-9), (column, prob)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(table, descending):
    rng = np.random.default_rng(6)
    scores = np.where(rng.uniform(0, 1, 3000) < 0.35, 0.5, rng.normal(0, 1, 3000).round(2))
    df = table([(float(s),) for s in scores], "s double")
    got = op.running_totals(df, "s", {"n": F.count(F.lit(1))}, descending, slice_points=16)
    for s, n, cum in values(got, "s", "n", "cum_n"):
        assert n == (scores == s).sum()
        assert cum == ((scores >= s) if descending else (scores <= s)).sum()
    assert got.count() == len(set(scores))


def test_a_shared_value_does_not_hold_all_slices(table, spark):
    """99.9 % of the rows share one score; the others still spread over many ranges."""
    many = spark.range(200_000).selectExpr("IF(id < 199800, 0.5D, id / 200000D) AS s")
    got = op.running_totals(many, "s", {"n": F.count(F.lit(1))}, slice_points=20)
    rows = sorted(values(got, "s", "n", "cum_n"))
    assert [r[2] for r in rows] == list(np.cumsum([r[1] for r in rows]))
    assert len(rows) == 201 and rows[0] == (0.5, 199_800, 199_800)
    slices = _sliced(many.groupBy("s").count(), "s", [], 20).groupBy("_slice").count()
    sizes = [r["count"] for r in slices.collect()]
    assert len(sizes) > 8 and max(sizes) <= 40


def test_running_totals_of_groups(table):
    rng = np.random.default_rng(8)
    data = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 60, 400)]
    data += [("single", 1.0)]
    df = table(data, "g string, s double")
    got = op.running_totals(df, "s", {"n": F.count(F.lit(1))}, by=["g"], slice_points=7)
    found = {(g, s): (n, cum) for g, s, n, cum in values(got, "g", "s", "n", "cum_n")}
    assert found == {
        (g, s): (data.count((g, s)), sum(h == g and v <= s for h, v in data)) for g, s in set(data)
    }
    crowd = table([(i, 1.0) for i in range(101)], "g int, s double")
    with pytest.raises(Exception, match="more than 100 groups"):
        op.running_totals(crowd, "s", {"n": F.count(F.lit(1))}, by=["g"]).collect()


def test_quantiles_of_extreme_values(table):
    inf, tiny, most = float("inf"), 5e-324, 1.7976931348623157e308
    rng = np.random.default_rng(9)
    n = 3000
    data = {
        "same": np.full(n, 3.5),
        "distinct": rng.permutation(n).astype(float),
        "ratio": np.exp(rng.uniform(-700, 700, n)) * rng.choice([-1, 1], n),
        "wide": rng.choice([-1.7e308, 0.0, 1.7e308], n),
        "crowded": np.where(rng.random(n) < 0.99, 0.1, rng.random(n)),
        "infinite": rng.choice([inf, -inf, 1.0, most], n),
        "tiny": rng.integers(0, 100, n) * tiny,
        "zeros": rng.choice([0.0, -0.0], n),
    }
    df = table(list(zip(*[map(float, v) for v in data.values()])), ", ".join(f"{c} double" for c in data))
    probs = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    for column, prob, value in values(op.exact_quantiles(df, list(data), probs, 32, 40), "column", "prob", "value"):
        ordered, rank = np.sort(data[column]), (n - 1) * prob
        low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
        want = low if low == high else low + (high - low) * (rank - math.floor(rank))
        assert value == pytest.approx(want, rel=1e-12) or (value != value and want != want), (column, prob)


def test_a_million_equal_and_a_million_distinct_values(spark):
    df = spark.range(1_000_000).selectExpr("7D AS same", "CAST(id * 48271 % 1000003 AS DOUBLE) AS mixed")
    ordered = sorted(i * 48271 % 1000003 for i in range(1_000_000))
    found = {(c, p): v for c, p, v in values(op.exact_quantiles(df, df.columns, [0.5, 0.9]), "column", "prob", "value")}
    assert found["same", 0.5] == found["same", 0.9] == 7.0
    assert found["mixed", 0.5] == (ordered[499_999] + ordered[500_000]) / 2
    low, high = ordered[899_999], ordered[900_000]
    assert found["mixed", 0.9] == pytest.approx(low + (high - low) * (999_999 * 0.9 - 899_999))


@pytest.mark.parametrize("width", [1, 5, 16, 40])
def test_correlations_of_columns_with_gaps(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) + 1e6
    x[:, -1] += x[:, 0]
    x[rng.random(x.shape) < 0.1] = np.nan
    if width > 4:
        x[:, 2] = 5.0
        x[:200, 3], x[200:, 4] = np.nan, np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)])
    want = frame.corr()
    rows = op.corr_matrix(spark.createDataFrame(frame)).collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == width * width
    for r in rows:
        expected = want.loc[r.a, r.b]
        assert (r.r is None and np.isnan(expected)) or r.r == pytest.approx(expected, abs=1e-7)


def test_describe_and_profile(table):
    df = table([(0.0, "a"), (1.0, None), (2.0, "b"), (3.0, None), (None, "c")], "x double, s string")
    stats = {s: v for _, s, v in values(op.describe(df), "column", "stat", "value")}
    assert stats["25%"] == 0.75 and stats["50%"] == 1.5 and stats["count"] == 4.0
    assert stats["std"] == pytest.approx(np.std([0, 1, 2, 3], ddof=1))
    assert len(op.describe(df, approx=True).collect()) == 8
    prof = {r.column: r for r in op.profile(df).collect()}
    assert (prof["s"].non_null, prof["s"].nulls, prof["s"].null_pct) == (3, 2, 40.0)
    assert prof["x"].type == "double"


def test_histogram(table):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 500)
    df = table([(float(v), 3) for v in x] + [(None, None)], "x double, k int")
    rows = op.histogram(df).orderBy("column", "bin").collect()
    mine = [r.n for r in rows if r.column == "x"]
    assert mine == list(np.histogram(x, 10)[0])
    assert [r.n for r in rows if r.column == "k"] == [0] * 5 + [500] + [0] * 4
    auto = op.histogram(df, ["x"], bins="auto").orderBy("bin").collect()
    assert [r.n for r in auto] == list(np.histogram(x, "auto")[0])


def test_density(table):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 300).round(1)
    got = op.density(table([(float(v),) for v in x], "x double"), "x").orderBy("x").collect()
    h = np.std(x, ddof=1) * 300 ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (300 * h * math.sqrt(2 * math.pi))
    assert np.allclose([r.x for r in got], grid) and np.allclose([r.density for r in got], want)


def test_correlation_is_pairwise_complete(table):
    df = table(
        [(1.0, 2.0, True, 1), (2.0, None, False, 1), (3.0, 5.0, True, 1), (4.0, 1.0, False, 1)],
        "a double, b double, c boolean, d int",
    )
    r = {(a, b): v for a, b, v in values(op.corr_matrix(df), "a", "b", "r")}
    assert len(r) == 16 and r["a", "a"] == 1.0 and r["d", "d"] is None
    assert r["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 1])[0, 1])
    assert r["a", "c"] == r["c", "a"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 0, 1, 0])[0, 1])


def test_nan_is_missing_in_profiles(table):
    nan, inf = float("nan"), float("inf")
    df = table([(1.0,), (2.0,), (3.0,), (nan,), (None,)], "x double")
    stats = {r.stat: r.value for r in op.describe(df).collect()}
    assert stats == {
        "count": 3.0, "mean": 2.0, "std": 1.0, "min": 1.0, "25%": 1.5, "50%": 2.0, "75%": 2.5, "max": 3.0,
    }
    wide = df.unionByName(table([(inf,), (-inf,)], "x double"))
    assert [r.n for r in op.histogram(wide, bins=2).orderBy("bin").collect()] == [1, 2]
    assert all(r.density == r.density and r.density < inf for r in op.density(wide, "x").collect())


def test_an_outlier_that_asks_for_too_many_bins_is_an_error(spark):
    df = spark.range(20_000).selectExpr("IF(id = 0, 1e9, id / 20000D) AS x")
    with pytest.raises(Exception, match="too many bins"):
        op.histogram(df, bins="auto").collect()


@pytest.mark.parametrize("few", [1, 1000])
def test_quantiles_of_few_and_many_rows(spark, few):
    for n in (1, 2, 3, 50, 5000):
        df = spark.range(n).selectExpr("CAST(id * id % 977 AS DOUBLE) AS x")
        values = sorted(i * i % 977 for i in range(n))
        for r in op.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.99, 1.0], few=few).collect():
            rank = (n - 1) * r.prob
            low, part = int(rank), rank - int(rank)
            high = values[min(low + 1, n - 1)]
            assert r.value == pytest.approx(values[low] + (high - values[low]) * part)
