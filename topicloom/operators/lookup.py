"""Code lookup by name, and list pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import strip_spaces
from topicloom.runtime import BROADCAST_BYTES, materialize, table_bytes


def name_dimension(dim: DataFrame, cut_at: str, name_col: str = "name", code_col: str = "code",
                   order_col: str = "position") -> DataFrame:
    """Lookup names: cut at the first ``cut_at`` character, trimmed, lower case."""
    cut = F.substring_index(F.col(name_col), cut_at, 1)
    return dim.select(
        F.col(order_col).alias("position"),
        F.lower(strip_spaces(cut)).alias("name"),
        F.col(code_col).alias("code"),
    )


def lookup_code(df: DataFrame, name_col: str, dim: DataFrame, contains: bool = False) -> DataFrame:
    """Add ``code`` for a name: exact match, else first row that contains it.

    ``dim`` has position (file order), name (lower case) and code.  Containment
    is an equi-join too: of every dimension name the substrings as long as a
    name asked for are listed, and those asked for keep the code of the first
    row that holds them.  Lookups are written first, so Spark sees their true
    size and broadcasts them when small.
    """
    key = F.lower(F.col(name_col))
    exact = materialize(
        dim.groupBy("name").agg(F.min_by("code", "position").alias("_exact")), "names"
    )
    out = df.withColumn("_key", key).join(exact.withColumnRenamed("name", "_key"), "_key", "left")
    if not contains:
        return out.withColumn("code", F.col("_exact")).drop("_key", "_exact")
    asked = materialize(out.select("_key").where(F.col("_key").isNotNull()).distinct(), "asked")
    # at most one number per length of a dimension name
    longest = dim.select(F.max(F.length("name")).alias("v")).scalar()
    sizes = asked.select(F.length("_key").alias("n")).where(F.col("n") <= longest).distinct()
    lengths = F.array(*[F.lit(r["n"]) for r in sizes.collect()]).cast("array<int>")
    length = F.length("name")
    parts = F.flatten(
        F.transform(
            F.filter(lengths, lambda n: n <= length),
            lambda n: F.transform(
                F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(F.col("name"), i, n)
            ),
        )
    )
    listed = (
        dim.select("position", "code", F.explode(F.array_distinct(parts)).alias("_key"))
        .join(asked, "_key", "left_semi")
        .groupBy("_key")
        .agg(F.min_by("code", "position").alias("_part"))
    )
    listed = materialize(listed, "substrings")
    return (
        out.join(listed, "_key", "left")
        .withColumn("code", F.coalesce("_exact", "_part"))
        .drop("_key", "_exact", "_part")
    )


def cross_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Every pair of items from two lists except equal ones: item1, item2.

    The result is a product by definition, so both sides must be short lists:
    each is measured, and one above the broadcast limit raises.
    """
    for df, name in ((left, left_col), (right, right_col)):
        if table_bytes(df, name) > BROADCAST_BYTES:
            raise ValueError(f"{name} is too long a list for a product")
    a = left.select(F.col(left_col).alias("item1"))
    b = right.select(F.col(right_col).alias("item2"))
    return a.join(b, F.col("item1") != F.col("item2"))
