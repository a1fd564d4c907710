"""Query-log cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import NOT_ALNUM_OR_SPACE, remove_terms, strip_spaces
from topicloom.runtime import compute_and_keep

MIN_QUERY_CHARS = 3


def integer_volume(volume: Column) -> Column:
    """Whole-number volume: anything missing, not a number or beyond a long counts as 0."""
    number = F.nanvl(F.coalesce(volume.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(number.try_cast("long"), F.lit(0).cast("long"))


def top_n_per_group(
    df: DataFrame, group: str | Sequence[str], n: int, order: Sequence[Column]
) -> DataFrame:
    """First ``n`` rows of each group; rows with a null group are dropped.

    Spark pushes the ``row_number <= n`` limit below the shuffle, so a group
    that holds most rows sends at most ``n`` rows per task.
    """
    keys = [group] if isinstance(group, str) else list(group)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.dropna(subset=keys)
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def clean_queries(
    df: DataFrame,
    kind: str = "provided",
    brand_terms: Iterable[str] | None = None,
    limit_per_page: int | None = None,
    strip: bool = True,
    phrases: bool = False,
) -> DataFrame:
    """Clean a query log.

    ``provided``: query, [page], search_volume.  Brand words go first, then
    characters outside letters, digits and white space, then short queries.
    ``performance``: query, page, clicks, impressions.  Text is lower-cased and
    stripped, short queries go, and brand words are removed last, so what
    remains of a query may be short.
    """
    brand_terms = list(brand_terms or [])
    query = F.col("query").cast("string")

    def stripped(c: Column) -> Column:
        return strip_spaces(F.regexp_replace(c, NOT_ALNUM_OR_SPACE, "") if strip else c)

    def long_enough(c: Column) -> Column:
        return F.length(c) >= MIN_QUERY_CHARS

    if kind == "provided":
        columns = ["query", *(["page"] if "page" in df.columns else []), "search_volume"]
        base = (
            df.select(*columns)
            .where(query.isNotNull())
            .withColumn("original_query", query)
            .withColumn("search_volume", integer_volume(F.col("search_volume")))
        )
        cleaned = stripped(remove_terms(query, brand_terms, phrases))
        out = compute_and_keep(base, "query", cleaned, long_enough)
        order = [F.desc("search_volume")]
    elif kind == "performance":
        base = df.where(query.isNotNull()).withColumn("original_query", query)
        out = (
            compute_and_keep(base, "query", stripped(F.lower(query)), long_enough)
            .withColumnRenamed("impressions", "search_volume")
            .withColumn("query", remove_terms(F.col("query"), brand_terms, phrases))
        )
        order = [F.desc("clicks"), F.desc("search_volume")]
    else:
        raise ValueError(f"unknown kind: {kind}")
    if limit_per_page and "page" in out.columns:
        out = top_n_per_group(
            out, "page", limit_per_page, [*order, F.asc("query"), F.asc("original_query")]
        )
    return out


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in a seeded random order of ``key``."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, F.col(key)).limit(n)
