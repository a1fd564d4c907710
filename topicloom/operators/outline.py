"""Category outlines and tables of category paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import outline_paths, path_levels, path_text
from topicloom.operators.rank import global_rank

OUTLIER_PATH = "Miscellaneous"


def outline_table(df: DataFrame, text_col: str = "outline") -> DataFrame:
    """One row per path of every outline, with its position in the outline."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(outline_paths(F.col(text_col))).alias("position", "path"))


def category_table(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Distinct paths as (category_id, path, path_text), ids by sorted path."""
    distinct = (
        paths.select(F.col(path_col).alias("path")).where(F.length("path") > 0).distinct()
    )
    ranked = global_rank(distinct, [F.asc("path")], "category_id")
    return ranked.select(
        (F.col("category_id") - 1).alias("category_id"),
        "path",
        path_text(F.col("path")).alias("path_text"),
    )


def with_outlier_path(categories: DataFrame) -> DataFrame:
    """Category table plus the outlier row, id -1."""
    outlier = categories.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("category_id"),
        F.lit(OUTLIER_PATH).alias("path"),
        F.lit(OUTLIER_PATH).alias("path_text"),
    )
    return categories.select("category_id", "path", "path_text").unionByName(outlier)


def split_levels(df: DataFrame, path_col: str, depth: int) -> DataFrame:
    """Path to ``level_1`` .. ``level_depth`` columns."""
    levels = path_levels(F.col(path_col))
    return df.withColumns({f"level_{i + 1}": F.get(levels, F.lit(i)) for i in range(depth)})
