"""Parsing, coercion and arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.schema import INCIDENT_TS

# The characters a decimal number is written with.
_NUMBER_CHARACTERS = "0123456789+-.eE"

ColumnOrName = Column | str


def _column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: ColumnOrName, fmt: str = INCIDENT_TS) -> Column:
    """Text to timestamp; text that does not fit the format gives null."""
    return F.try_to_timestamp(_column(c), F.lit(fmt))


def format_ts(c: ColumnOrName, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_column(c), fmt)


def parse_number(c: ColumnOrName) -> Column:
    """Decimal text to double; other text (including Java's `7d`) gives null."""
    text = F.trim(_column(c).cast("string"))
    plain = F.translate(text, _NUMBER_CHARACTERS, "") == ""
    return F.when(plain, text.try_cast("double"))


def coerce_int(c: ColumnOrName, default: int | None = 0) -> Column:
    """Number or text to int, cut toward zero; `default` where there is none."""
    value = parse_number(c).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_point(c: ColumnOrName) -> Column:
    """`(lat, long)` text to a struct of two doubles, null if either is bad."""
    text = _column(c)
    inner = F.when(
        text.startswith("(") & text.endswith(")"), text.substr(F.lit(2), F.length(text) - 2)
    )
    lat = parse_number(F.split_part(inner, F.lit(","), F.lit(1)))
    long = parse_number(F.split_part(inner, F.lit(","), F.lit(2)))
    return F.when(
        lat.isNotNull() & long.isNotNull(), F.struct(lat.alias("lat"), long.alias("long"))
    )


def pct(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """`part / whole * 100`, null where `whole` is 0 or null."""
    return F.try_divide(_column(part), _column(whole)) * 100


def finite_or_zero(c: ColumnOrName) -> Column:
    """Null, NaN and both infinities become 0.0."""
    x = _column(c).cast("double")
    inf = float("inf")
    bad = x.isNull() | F.isnan(x) | x.isin(inf, -inf)
    return F.when(bad, F.lit(0.0)).otherwise(x)


def unit_hash(key: ColumnOrName, seed: int) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the key.

    It stays the same when a lost task runs again, unlike a random column.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), _column(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
