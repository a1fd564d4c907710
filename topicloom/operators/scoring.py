"""Scaling and scoring of topic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_scale(df: DataFrame, *columns: str) -> DataFrame:
    """Divide columns by their maxima; a maximum of 0 gives null.

    The maxima come from a one-row scalar subquery, so rows are not shuffled.
    """
    tops = F.struct(*[F.max(c).cast("double").alias(c) for c in columns])
    top = df.select(tops.alias("v")).scalar()
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), top[c]) for c in columns})


def row_mean(*columns: str) -> Column:
    """Mean of a row's values that skips nulls; null when all are null."""
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    added = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(added, F.size(values))
