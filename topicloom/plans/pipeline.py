"""End to end: query log to topics, outline and tagged rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.clean import clean_queries
from topicloom.operators.enrich import enrich_with_callable
from topicloom.operators.rank import MAX_SAMPLES, select_topics, topics_markdown
from topicloom.plans.tagging import add_categories, encode_with_categories, read_outline
from topicloom.plans.topics import scored_topics
from topicloom.runtime import materialize
from topicloom.sources.discovery import rename_url_column
from topicloom.sources.readers import read_queries, source_kind


@dataclass
class CategoryBuild:
    """Categories (category_id, path, path_text), tagged rows, topics, prompt table.

    ``scored`` has every topic with its score, ``topics`` those left by the cut.
    """

    categories: DataFrame
    tagged: DataFrame
    topics: DataFrame
    query_data: DataFrame
    scored: DataFrame


def _answer(prompts: DataFrame, ask: Callable[[str], str], column: str, name: str) -> DataFrame:
    """One row, column ``outline``: what ``ask`` says to the text in ``column``; raises if it fails."""
    answered = materialize(enrich_with_callable(prompts, ask, column, "_answer"), "outline")
    if answered.where("_answer is null").limit(1).count():
        raise RuntimeError(f"{name} gave no outline")
    return answered.selectExpr("_answer AS outline")


def build_categories(
    queries: DataFrame | str,
    outline: DataFrame | str | None = None,
    write_outline: Callable[[str], str] | None = None,
    kind: str = "provided",
    ngram_range: tuple[int, int] = (1, 5),
    min_df: int | float = 5,
    brand_terms: Iterable[str] | None = None,
    limit_queries_per_page: int | None = 5,
    encoder: Callable | None = None,
    cross_encoded: bool = False,
    stop_words: Iterable[str] = ENGLISH,
    review_outline: Callable[[str], str] | None = None,
    max_samples: int = MAX_SAMPLES,
    min_length: int | None = None,
    page_col: str | None = None,
    spark: SparkSession | None = None,
    reading: dict | None = None,
    **rescoring,
) -> CategoryBuild:
    """Clean, score topics, read the outline, tag the rows.

    ``queries`` has query and search_volume (``provided``; one column of page
    addresses, or ``page_col``, turns the per-page limit on) or query, page,
    clicks, impressions (``performance``).  A CSV path or a property address is
    read by ``read_queries`` in the session ``spark``, with the options in
    ``reading``.  Every row is tagged; one without a query gets the outlier path.

    The outline is text, a table with column ``outline``, or written by
    ``write_outline`` from the topics' markdown table and then gone over by
    ``review_outline``.
    """
    if isinstance(queries, str):
        spark = spark or SparkSession.getActiveSession()
        if source_kind(queries) == "performance":
            kind = "performance"
        queries = read_queries(spark, queries, **(reading or {}))
    limit = limit_queries_per_page
    source = queries
    if kind == "provided":
        source, found = rename_url_column(queries, page_col)
        limit = limit if found else None
    cleaned = materialize(clean_queries(source, kind, brand_terms, limit), "clean")
    scored = materialize(scored_topics(cleaned, ngram_range, min_df, stop_words), "scored")
    topics = materialize(select_topics(scored, "score", max_samples, min_length), "topics")
    query_data = topics_markdown(topics)
    if outline is None:
        if write_outline is None:
            raise ValueError("give outline or write_outline")
        outline = _answer(query_data, write_outline, "markdown", "write_outline")
        if review_outline is not None:
            outline = _answer(outline, review_outline, "outline", "review_outline")
    categories = materialize(read_outline(outline, queries.sparkSession), "paths")
    rows = cleaned if kind == "performance" else source
    bare = rows.drop("embedding")
    ready, placed = encode_with_categories(bare, categories, encoder=encoder)
    tagged = add_categories(ready, placed, cross_encoded=cross_encoded, **rescoring)
    return CategoryBuild(categories, tagged.drop("embedding"), topics, query_data, scored)
