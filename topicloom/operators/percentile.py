"""Exact percentile of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.rank import positions


def exact_percentile(df: DataFrame, value_col: str, percent: float) -> DataFrame:
    """One row, column ``value``: the percentile with linear interpolation.

    Equal values are counted first (partial sums), so a value that most rows
    share is one row; the distinct values are sorted and ranked by running
    counts.  The built-in exact aggregate keeps every distinct value in one task.
    """
    values = df.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counted, [F.asc("v")])
    parts = placed.groupBy("_part").agg(F.sum("n").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    before = parts.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    running = F.sum("n").over(Window.partitionBy("_part").orderBy("_pos"))
    ranked = placed.withColumn("_upto", running).join(F.broadcast(before), "_part")
    last = F.col("_before") + F.col("_upto")
    n = placed.select(F.sum("n").alias("n")).scalar()
    at = F.lit(percent / 100.0) * (n - 1)
    below = F.min(F.when(last >= F.floor(at) + 1, F.col("v")))
    above = F.min(F.when(last >= F.ceil(at) + 1, F.col("v")))
    return ranked.agg((below + (above - below) * (at - F.floor(at))).alias("value"))
