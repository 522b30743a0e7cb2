"""Column expressions; all of them run inside the JVM."""

from blotter.functions.columns import (
    coerce_int,
    finite_or_zero,
    format_ts,
    parse_point,
    parse_ts,
    pct,
    unit_hash,
)

__all__ = [
    "coerce_int",
    "finite_or_zero",
    "format_ts",
    "parse_point",
    "parse_ts",
    "pct",
    "unit_hash",
]
