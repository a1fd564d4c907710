"""Scans, source-specific roll-ups and sinks."""
from topicloom.sources.readers import (
    find_property,
    parse_category_lines,
    performance_rollup,
    property_listing,
    read_queries,
    standardize_columns,
    write_table,
)
from topicloom.sources.discovery import detect_url_column, rename_url_column

__all__ = [
    "detect_url_column",
    "find_property",
    "parse_category_lines",
    "performance_rollup",
    "property_listing",
    "read_queries",
    "rename_url_column",
    "standardize_columns",
    "write_table",
]
