"""Running totals and exact quantiles without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Most slices of a group, distinct points that ask for one more, and most groups.
SLICES, SLICE_POINTS, MOST_GROUPS = 1000, 100_000, 100


def running_totals(
    rows: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    by: Sequence[str] = (),
    slice_points: int = SLICE_POINTS,
) -> DataFrame:
    """(by..., order, sums..., cum_sums...) per distinct value of `order` in each group.

    The distinct points of a group are cut into ranges of about `slice_points`, at approximate
    quantiles of the points themselves, so a value that most rows share is one point and
    the others still spread. Totals per range give each range its starting point, and the
    running sums are then formed inside every range on its own. There may be up to
    `MOST_GROUPS` groups, which bounds the cuts and the starting points that are broadcast.
    """
    names = list(sums)
    points = rows.groupBy(*by, order).agg(*[c.alias(n) for n, c in sums.items()])
    placed = _sliced(points, order, by, slice_points)
    by_slice = F.desc("_slice") if descending else F.asc("_slice")
    by_value = F.desc(order) if descending else F.asc(order)
    earlier = (
        Window.partitionBy("_group").orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("_group", "_slice")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            "_group",
            "_slice",
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_start_{n}") for n in names],
        )
    )
    inside = (
        Window.partitionBy("_group", "_slice")
        .orderBy(by_value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.join(F.broadcast(starts), ["_group", "_slice"]).select(
        *by,
        order,
        *names,
        *[(F.col(f"_start_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in names],
    )


def _sliced(points: DataFrame, order: str, by: Sequence[str], slice_points: int) -> DataFrame:
    """Add `_group` and `_slice`, the number of the range that a point of its group lies in."""
    group = F.struct(F.lit(0).alias("_"), *by)
    # As text: a list of this length takes long to hand over one by one.
    fractions = ", ".join(f"{i / SLICES}D" for i in range(1, SLICES))
    cuts = points.groupBy(group.alias("_group")).agg(
        F.expr(f"percentile_approx(`{order}`, array({fractions}), {10 * SLICES})").alias("_cuts"),
        F.count(F.lit(1)).alias("_points"),
    )
    wanted = F.least(F.ceil(F.col("_points") / slice_points), F.lit(SLICES))
    # Every step-th quantile is a cut.
    step = F.floor(F.lit(SLICES) / wanted)
    thinned = cuts.select(
        "_group", F.filter("_cuts", lambda cut, i: F.pmod(i + 1, step) == 0).alias("_cuts")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("_group", "_cuts")))
    too_many = F.raise_error(F.lit(f"running totals of more than {MOST_GROUPS} groups"))
    lookup = thinned.agg(
        F.when(F.count(F.lit(1)) <= MOST_GROUPS, entries).otherwise(too_many).alias("cuts")
    ).scalar()
    # Never null, so that a join on it adds no null check, which would move
    # the search for the slice down to the single rows.
    earlier_cuts = F.filter(F.try_element_at("_cuts", group), lambda cut: cut < F.col(order))
    place = F.coalesce(F.size(earlier_cuts), F.lit(0))
    placed = points.withColumn("_cuts", lookup).withColumn("_slice", place).drop("_cuts")
    return placed.withColumn("_group", group)


def present(df: DataFrame, name: str, finite: bool = False) -> Column:
    """A numeric column as double with NaN, and infinite values if asked for, as null."""
    value = F.col(f"`{name}`").cast("double")
    if dict(df.dtypes)[name] not in ("float", "double"):
        return value
    missing = F.isnan(value) | (F.abs(value) == float("inf")) if finite else F.isnan(value)
    return F.when(~missing, value)


def to_long(df: DataFrame, cols: Sequence[str], finite: bool = False) -> DataFrame:
    """(column, value double) of the given numeric columns, missing values left out."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), present(df, c, finite).alias("value"))
            for c in cols
        ]
    )
    return df.select(F.inline(entries)).filter(F.col("value").isNotNull())


@dataclass
class _Range:
    """Values of a column from `lo` to `hi`, of which `ranks` (from `before`) are wanted."""

    column: str
    lo: float
    hi: float
    before: int
    count: int
    ranks: list[int]
    logarithmic: bool = False


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    digits: int = 1024,
    few: int = 20_000,
) -> DataFrame:
    """(column, prob, value): quantiles with linear interpolation; NaN counts as missing.

    Distributed selection: the range of each column is cut into `digits` parts, the values
    of every part are counted, and only the parts that hold a wanted rank are cut further,
    until a part has one value or all parts together have at most `few` values, which are
    then counted one by one. A pass sends `digits` rows per task and open part, whatever the
    values are; nothing is sorted, and no estimate can miss. Parts are of equal width, and of
    equal ratio after a pass that left most of a range in one part.
    """
    probs = sorted(float(p) for p in probs)
    numbers = {c: present(df, c) for c in cols}
    row = df.agg(
        *[
            F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"_{i}")
            for i, v in enumerate(numbers.values())
        ]
    ).first()
    sizes = {c: r["n"] for c, r in zip(cols, row) if r["n"]}
    found: dict[tuple[str, int], float] = {}
    open_ranges = []
    for c, r in zip(cols, row):
        if r["n"]:
            places = [(r["n"] - 1) * p for p in probs]
            ranks = sorted({f(place) for place in places for f in (math.floor, math.ceil)})
            open_ranges.append(_Range(c, r["lo"], r["hi"], 0, r["n"], ranks))
    while True:
        for r in open_ranges:
            if r.lo == r.hi:
                found |= {(r.column, rank): r.lo for rank in r.ranks}
        open_ranges = [r for r in open_ranges if r.lo != r.hi]
        if not open_ranges:
            break
        open_ranges = _narrowed(df, numbers, open_ranges, digits, few)

    def between(c: str, p: float) -> float:
        place = (sizes[c] - 1) * p
        a, b = found[c, math.floor(place)], found[c, math.ceil(place)]
        return a if a == b else a + (b - a) * (place - math.floor(place))

    rows = [(c, p, between(c, p)) for c in sizes for p in probs]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def _narrowed(
    df: DataFrame, numbers: Mapping[str, Column], ranges: list[_Range], digits: int, few: int
) -> list[_Range]:
    """The parts of `ranges` that hold their ranks, by one pass over the data."""
    entries = []
    for c in {r.column: None for r in ranges}:
        at = F.lit(None).cast("int")
        for i, r in enumerate(ranges):
            if r.column == c:
                at = F.when(numbers[c].between(r.lo, r.hi), F.lit(i)).otherwise(at)
        entries.append(F.struct(at.alias("range"), numbers[c].alias("value")))
    inside = df.select(F.inline(F.array(*entries))).filter("range IS NOT NULL")
    if sum(r.count for r in ranges) <= few:
        part = F.col("value")
    else:
        part = _digit(ranges, digits)
    counted = inside.groupBy("range", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    kept = []
    rows = sorted(counted.select("range", "lo", "hi", "n").collect())
    for i, parts in groupby(rows, key=lambda row: row["range"]):
        r, before = ranges[i], ranges[i].before
        for row in parts:
            ranks = [rank for rank in r.ranks if before <= rank < before + row["n"]]
            if ranks:
                crowded = row["n"] * 8 > r.count
                kept.append(
                    _Range(r.column, row["lo"], row["hi"], before, row["n"], ranks, crowded and not r.logarithmic)
                )
            before += row["n"]
    return kept


def _digit(ranges: list[_Range], digits: int) -> Column:
    """The part of its range that a value lies in, never falling with the value.

    The highest value of a range has the last part to itself, so every pass splits every range.
    """
    greatest = 1.7976931348623157e308

    def bounded(x: float) -> float:
        return min(max(x, -greatest), greatest)

    def ratio(x: float) -> float:
        return math.copysign(math.log(abs(x)) + 750, x) if x else 0.0

    def per_range(make) -> Column:
        return F.get(F.lit([make(r) for r in ranges]), F.col("range"))

    value = F.greatest(F.least(F.col("value"), F.lit(greatest)), F.lit(-greatest))
    size = F.log(F.when(value == 0, 1.0).otherwise(F.abs(value))) + 750
    by_ratio = F.when(value == 0, 0.0).when(value > 0, size).otherwise(-size)
    scaled = F.when(per_range(lambda r: r.logarithmic), by_ratio).otherwise(value / 2)

    def end(r: _Range, x: float) -> float:
        return ratio(bounded(x)) if r.logarithmic else bounded(x) / 2

    lo = per_range(lambda r: end(r, r.lo))
    width = per_range(lambda r: (end(r, r.hi) - end(r, r.lo)) or 1.0)
    place = F.floor((scaled - lo) / width * (digits - 1))
    below = F.greatest(F.least(place, F.lit(digits - 2)), F.lit(0))
    return F.when(F.col("value") >= per_range(lambda r: r.hi), F.lit(digits - 1)).otherwise(below)
