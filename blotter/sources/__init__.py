"""Readers, writers, views and the area lookup."""

from blotter.sources.files import (
    concat,
    csv_headers,
    first_rows,
    read_incidents_csv,
    read_parquet,
    take_first,
    write_csv,
)
from blotter.sources.lookup import AREA_TEXT, area_lookup, parse_lookup_text
from blotter.sources.tables import keep_cached, register, save_table, scan_view

__all__ = [
    "AREA_TEXT",
    "area_lookup",
    "concat",
    "csv_headers",
    "first_rows",
    "keep_cached",
    "parse_lookup_text",
    "read_incidents_csv",
    "read_parquet",
    "register",
    "save_table",
    "scan_view",
    "take_first",
    "write_csv",
]
