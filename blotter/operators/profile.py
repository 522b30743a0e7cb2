"""Data-quality profile: nulls, summaries, histograms, densities, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions import pct
from blotter.operators.clean import columns_of_type
from blotter.operators.ordered import exact_quantiles, present, to_long

#: Share of a mean square below which a variance is rounding only.
NO_SPREAD = 1e-13
#: Rows whose means the values of a correlation matrix are moved by.
SHIFT_ROWS = 1000
#: Columns of one block of a correlation matrix: two blocks are added up together.
CORR_BLOCK = 7


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return columns_of_type(df, *kinds)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null, nulls, null_pct), all columns in one aggregation."""
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.count(F.col(f"`{name}`")).alias("non_null"),
            F.count_if(F.col(f"`{name}`").isNull()).alias("nulls"),
        )
        for name, kind in df.dtypes
    ]
    return (
        df.agg(F.array(*entries).alias("_columns"))
        .select(F.inline("_columns"))
        .withColumn("null_pct", pct(F.col("nulls"), F.col("nulls") + F.col("non_null")))
    )


def describe(
    df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """(column, stat, value): count, mean, std, min, 25%, 50%, 75%, max.

    Quartiles are exact unless `approx` asks for Spark's sketch. NaN counts as missing.
    """
    cols = list(cols) if cols else numeric_columns(df)
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    plain = {
        "count": lambda c: F.count(c).cast("double"),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    if approx:
        plain |= {
            label: (lambda c, p=p: F.percentile_approx(c, p).cast("double"))
            for label, p in quartiles.items()
        }

    def entry(c: str, stat: str):
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(stat).alias("stat"),
            plain[stat](present(df, c)).alias("value"),
        )

    simple = df.agg(
        F.array(*[entry(c, stat) for c in cols for stat in plain]).alias("_stats")
    ).select(F.inline("_stats"))
    if approx:
        return simple
    label = F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%"))
    exact = exact_quantiles(df, cols, list(quartiles.values()))
    return simple.unionByName(exact.select("column", label.alias("stat"), "value"))


def histogram(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    bins: int | str = 10,
    most_bins: int = 100_000,
) -> DataFrame:
    """(column, bin, lo, hi, n): equal-width bins, the last one closed on the right.

    `bins="auto"` takes the narrower of the Freedman-Diaconis and the Sturges
    width per column; an outlier that asks for more than `most_bins` bins is an error.
    Empty bins are listed with 0. A column without spread gets the unit-wide range
    around its value. NaN and infinite values count as missing.
    """
    cols = list(cols) if cols else numeric_columns(df)
    df = df.select(*[present(df, c, finite=True).alias(c) for c in cols])
    long = to_long(df, cols)
    edges = _edges(df, long, cols, bins)
    told = F.concat(F.lit("too many bins for "), "column", F.lit(": "), F.col("bins").cast("string"))
    allowed = F.when(F.col("bins") <= most_bins, F.col("bins")).otherwise(F.raise_error(told))
    edges = edges.withColumn("bins", allowed.cast("long"))
    # One row per column: the schema bounds what is broadcast.
    counts = (
        long.join(F.broadcast(edges), "column")
        .withColumn(
            "bin",
            F.least(
                F.floor((F.col("value") - F.col("lo")) / F.col("width")),
                F.col("bins") - 1,
            ),
        )
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = edges.select(
        "column",
        "lo",
        "width",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"),
    )
    return (
        all_bins.join(counts, ["column", "bin"], "left")
        .select(
            "column",
            F.col("bin").cast("int").alias("bin"),
            (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def _edges(
    df: DataFrame, long: DataFrame, cols: Sequence[str], bins: int | str
) -> DataFrame:
    """(column, lo, width, bins) from the range of each column."""
    ranges = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )
    flat = F.col("_min") == F.col("_max")
    lo = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
    span = F.when(flat, F.lit(1.0)).otherwise(F.col("_max") - F.col("_min"))
    if bins != "auto":
        width = span / F.lit(float(bins))
        count = F.lit(int(bins)).cast("long")
        return ranges.select("column", lo.alias("lo"), width.alias("width"), count.alias("bins"))
    quartiles = exact_quantiles(df, cols, [0.25, 0.75])
    iqr = quartiles.groupBy("column").agg((F.max("value") - F.min("value")).alias("_iqr"))
    sturges = span / (F.log2("_n") + 1)
    freedman = F.col("_iqr") * 2 / F.cbrt("_n")
    target = F.when(freedman > 0, F.least(sturges, freedman)).otherwise(sturges)
    count = F.when(flat, F.lit(1)).otherwise(F.ceil(span / target)).cast("long")
    return (
        ranges.join(iqr, "column")
        .withColumn("bins", count)
        .select("column", lo.alias("lo"), (span / F.col("bins")).alias("width"), "bins")
    )


def density(df: DataFrame, column: str, grid: int = 200) -> DataFrame:
    """(x, density): Gaussian density estimate on an even grid from min to max.

    NaN and infinite values count as missing. Bandwidth is the standard deviation times
    n^(-1/5). Equal values are
    counted first, and each task adds up its part of the grid before the
    shuffle of `grid` rows.
    """
    values = df.select(present(df, column, finite=True).alias("v")).filter("v IS NOT NULL")
    stats = values.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            (F.stddev_samp("v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias(
                "h"
            ),
        ).alias("stats")
    ).scalar()
    step = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(grid - 1))
    weighed = values.groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("s", stats)
    points = weighed.select(
        "v", "k", "s", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    ).withColumn("x", F.col("s.lo") + F.col("i") * step)
    u = (F.col("x") - F.col("v")) / F.col("s.h")
    kernel = F.col("k") * F.exp(u * u * F.lit(-0.5))
    scale = F.first(F.col("s.n") * F.col("s.h")) * F.lit(math.sqrt(2 * math.pi))
    return (
        points.groupBy("i")
        .agg(F.first("x").alias("x"), (F.sum(kernel) / scale).alias("density"))
        .select("x", "density")
    )


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns.

    Numeric and boolean columns by default; a pair uses the rows where both
    are present. It is null when one of them has no spread there, for which
    Spark's own `corr` raises a division by zero.

    Rows are grouped by their pattern of missing columns, and each pattern adds up the values,
    less the means of a few rows, and their products. A pair takes the sums of the patterns that
    have both. All pairs of up to `2 * CORR_BLOCK` columns come from one aggregation; further
    columns are cut into blocks, and a row goes once to each pair of blocks, so there are
    never more sums in a group nor more patterns than that number of columns gives.
    """
    cols = list(cols) if cols else numeric_columns(df, booleans=True)
    kinds = dict(df.dtypes)

    def number(c: str):
        if kinds[c] == "boolean":
            return F.col(f"`{c}`").cast("int").cast("double")
        return present(df, c)

    row = df.select(*[number(c).alias(f"_{i}") for i, c in enumerate(cols)])
    # Sums about a value near the column's keep their digits; any rows will do for it.
    near = ", ".join(f"coalesce(avg({c}), 0D) AS {c}" for c in row.columns)
    some = row.limit(SHIFT_ROWS).agg(F.expr(f"struct({near})").alias("near"))
    moved = row.withColumn("_near", some.scalar()).selectExpr(
        *[f"{c} - _near.{c} AS {c}" for c in row.columns]
    )
    sums = _moments(moved, len(cols)).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]
    )

    def spread(square: str, total: str) -> Column:
        # What rounding leaves of a column without spread is no spread.
        left = F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(left > F.col(square) * NO_SPREAD, left)

    both = F.sqrt(spread("xx", "x") * spread("yy", "y"))
    r = (F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))) / both
    bounded = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    r = F.when(F.col("i") == F.col("j"), r * 0 + 1).otherwise(bounded)
    names = F.lit(cols)
    sums = sums.select("i", "j", r.alias("r"), F.get(names, "i").alias("_i"), F.get(names, "j").alias("_j"))

    def cell(a: str, b: str):
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "r")

    mirrored = F.when(F.col("i") < F.col("j"), F.array(cell("_i", "_j"), cell("_j", "_i")))
    return sums.select(F.inline(F.coalesce(mirrored, F.array(cell("_i", "_j")))))


def _moments(row: DataFrame, width: int) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for columns i <= j of `row`, one per pattern of missing ones.

    Columns without a common row have one with n = 0.
    """
    blocks = [range(at, min(at + CORR_BLOCK, width)) for at in range(0, width, CORR_BLOCK)]
    couples = [(a, b) for a in range(len(blocks)) for b in range(a + 1, len(blocks))] or [(0, 0)]
    # Which columns a couple of blocks holds, and which of their pairs it answers for: pairs
    # within a block belong to the first couple that has the block.
    slots, owned, seen = [], [], set()
    for a, b in couples:
        places = [*blocks[a], *(blocks[b] if b != a else [])]
        pairs = {(i, j) for i in places for j in places if i <= j} - seen
        seen |= pairs
        slots.append(places)
        owned.append(pairs)
    most = max(map(len, slots))

    def couple(number: int) -> str:
        held = [f"_{i}" for i in slots[number]]
        held += ["CAST(NULL AS DOUBLE)"] * (most - len(held))
        named = ", ".join(f"{c} AS s{k}" for k, c in enumerate(held))
        return f"struct({number} AS couple, {named})"

    dealt = row.selectExpr(f"inline(array({', '.join(map(couple, range(len(slots))))}))")
    mask = " | ".join(f"if(s{k} IS NULL, 0, {1 << k})" for k in range(most))
    filled = dealt.selectExpr(
        "couple", f"{mask} AS mask", *[f"coalesce(s{k}, 0D) AS s{k}" for k in range(most)]
    )
    places = [(k, m) for k in range(most) for m in range(k, most)]
    totals = [f"sum(s{k}) AS t{k}" for k in range(most)]
    totals += [f"sum(s{k} * s{m}) AS p{k}_{m}" for k, m in places]
    # One statement: this many columns take long to hand over one by one.
    grouped = row.sparkSession.sql(
        f"SELECT couple, mask, CAST(count(1) AS DOUBLE) AS n, {', '.join(totals)} "
        "FROM {filled} GROUP BY couple, mask",
        filled=filled,
    )

    def entry(k: int, m: int) -> str:
        # The columns of the pair of slots in each couple; -1 where it does not answer for it.
        def column(at: int) -> str:
            known = [
                p[at] if max(k, m) < len(p) and (p[k], p[m]) in own else -1
                for p, own in zip(slots, owned)
            ]
            return f"get(array({', '.join(map(str, known))}), couple)"

        bits = 1 << k | 1 << m
        sums = {"n": "n", "x": f"t{k}", "y": f"t{m}", "xx": f"p{k}_{k}", "yy": f"p{m}_{m}", "xy": f"p{k}_{m}"}
        held = ", ".join(f"if(mask & {bits} = {bits}, {c}, 0D) AS {name}" for name, c in sums.items())
        return f"struct({column(k)} AS i, {column(m)} AS j, {held})"

    entries = ", ".join(entry(k, m) for k, m in places)
    return grouped.selectExpr(f"inline(array({entries}))").filter("i >= 0")
