"""Query-log readers, the performance roll-up, property tables, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topicloom.functions.text import PROPERTY_PREFIX


def source_kind(source: str | DataFrame) -> str:
    """``performance`` for a property address, ``file`` for CSV, ``table`` for rows.

    A property address wins over a ``.csv`` ending.
    """
    if isinstance(source, DataFrame):
        return "table"
    if isinstance(source, str):
        if "sc-domain:" in source or "https://" in source:
            return "performance"
        if ".csv" in source:
            return "file"
    raise ValueError("source must be a property address, a CSV path, or a DataFrame")


def standardize_columns(df: DataFrame, text_col: str, volume_col: str) -> DataFrame:
    """Rename the user's text and volume columns to query and search_volume."""
    return df.withColumnsRenamed({text_col: "query", volume_col: "search_volume"})


def read_queries(
    spark: SparkSession,
    source: str | DataFrame,
    text_col: str = "query",
    volume_col: str = "search_volume",
    kind: str | None = None,
    schema: StructType | str | None = None,
    performance: DataFrame | None = None,
    days: int = 30,
    end_date: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Query log from a CSV path, a table, or exported daily performance rows.

    CSV columns stay text unless ``schema`` is given, so no extra pass infers
    types; volumes are cast during cleaning.  ``multi_line`` allows line breaks
    inside quotes; such files are read by one task each.  For a property address pass the
    exported rows as ``performance`` (columns property, date, query, page,
    clicks, impressions).  An address without rows of its own is searched for
    in the others; one hit is used, none or several raise.
    """
    kind = kind or source_kind(source)
    if kind == "table":
        return standardize_columns(source, text_col, volume_col)
    if kind == "file":
        reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
        if schema is not None:
            reader = reader.schema(schema)
        return standardize_columns(reader.csv(source), text_col, volume_col)
    if kind == "performance":
        if performance is None:
            raise ValueError("pass the exported daily rows as performance=")
        name = _known_property(performance, source)
        return performance_rollup(performance.where(F.col("property") == name), days, end_date)
    raise ValueError(f"unknown source kind: {kind}")


def _known_property(performance: DataFrame, source: str) -> str:
    """``source`` if it has rows, else the one property whose address holds it."""
    if performance.where(F.col("property") == source).limit(1).count():
        return source
    holds = performance.where(F.contains("property", F.lit(source))).select("property").distinct()
    found = [r["property"] for r in holds.orderBy("property").limit(10).collect()]
    if len(found) != 1:
        raise ValueError(f"no property {source}" if not found else f"{source} may be {', '.join(found)}")
    return found[0]


def performance_rollup(daily: DataFrame, days: int = 30, end_date: str | None = None) -> DataFrame:
    """Clicks and impressions per query and page over the last ``days`` days."""
    end = F.to_date(F.lit(end_date)) if end_date else F.current_date()
    return (
        daily.where(F.col("date").between(F.date_sub(end, days), end))
        .groupBy("query", "page")
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    )


def property_listing(properties: DataFrame) -> DataFrame:
    """Property table with its bare domain, the source type and an empty table name."""
    return properties.select(
        "property",
        F.regexp_replace("property", PROPERTY_PREFIX, "").alias("property_domain"),
        F.lit("gsc").alias("type"),
        F.lit(None).cast("string").alias("table"),
    )


def find_property(properties: DataFrame, pattern: str) -> DataFrame:
    """All properties whose address matches ``pattern`` anywhere."""
    return properties.where(F.col("property").rlike(pattern))


def parse_category_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Headerless ``ngram,category`` lines to two columns."""
    parsed = F.from_csv(F.col(line_col), "ngram string, category string")
    return (
        df.where(F.length(F.trim(line_col)) > 0)
        .select(parsed.alias("r"))
        .select("r.ngram", "r.category")
    )


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Write a result as CSV (with header) or parquet, one file per task."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
