"""Finding the one column that holds page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from topicloom.functions.text import URL_START

def detect_url_column(df: DataFrame) -> DataFrame:
    """One row per string column whose values all look like addresses.

    Nulls pass, but at least one value must match.  All rows are tested, as a
    table has no first ones; one partial aggregate reads the string columns.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    checks = []
    for name in names:
        hit = F.col(f"`{name}`").rlike(URL_START)
        checks.append(
            F.struct(
                F.lit(name).alias("column"),
                F.every(F.coalesce(hit, F.lit(True))).alias("all_match"),
                F.max(F.coalesce(hit, F.lit(False))).alias("any_match"),
            )
        )
    if not checks:
        return df.sparkSession.createDataFrame([], "column string")
    return (
        df.agg(F.array(*checks).alias("c"))
        .select(F.inline("c"))
        .where("all_match and any_match")
        .select("column")
    )


def rename_url_column(df: DataFrame, column: str | None = None) -> tuple[DataFrame, bool]:
    """Rename the only address column, or ``column``, to page; the flag tells if there was one."""
    if column is not None:
        return df.withColumnRenamed(column, "page"), True
    found = [r["column"] for r in detect_url_column(df).limit(2).collect()]
    if len(found) != 1:
        return df, False
    return df.withColumnRenamed(found[0], "page"), True
