"""From a cleaned query log to scored topics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.containment import ngram_volume
from topicloom.operators.ngrams import merge_ngrams, ngram_frequency
from topicloom.operators.rank import MAX_SAMPLES, select_topics
from topicloom.operators.scoring import max_scale, row_mean
from topicloom.runtime import materialize


def scored_topics(
    queries: DataFrame,
    ngram_range: tuple[int, int] = (1, 5),
    min_df: int | float = 5,
    stop_words: Iterable[str] = ENGLISH,
    query_col: str = "query",
    volume_col: str = "search_volume",
) -> DataFrame:
    """Every topic with its score, before the cut.

    score is the mean of the scaled volume and the scaled merged frequency.
    """
    counts = materialize(
        ngram_frequency(queries, query_col, ngram_range, min_df, stop_words), "counts"
    )
    merged = materialize(merge_ngrams(counts), "merged")
    words = counts.where(~F.contains("feature", F.lit(" "))).select(
        F.col("feature").alias("word"), F.col("frequency").alias("n")
    )
    volumes = materialize(
        ngram_volume(merged, queries, query_col, volume_col, frequency=words), "volumes"
    )
    return (
        max_scale(volumes, "search_volume")
        .withColumn("score", row_mean("search_volume", "merged_frequency"))
        .select(
            F.col("feature").alias("query"),
            "ngram_size",
            "search_volume",
            "merged_frequency",
            "frequency",
            "score",
        )
    )


def score_topics(
    queries: DataFrame,
    ngram_range: tuple[int, int] = (1, 5),
    min_df: int | float = 5,
    min_length: int | None = None,
    max_samples: int = MAX_SAMPLES,
    stop_words: Iterable[str] = ENGLISH,
) -> DataFrame:
    """Scored topics cut at the knee, best first."""
    scored = scored_topics(queries, ngram_range, min_df, stop_words)
    return select_topics(scored, "score", max_samples, min_length)
