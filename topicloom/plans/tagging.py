"""Tagging rows with category paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.encode import encode_texts
from topicloom.operators.nearest import assign_nearest, top_n_categories
from topicloom.operators.outline import OUTLIER_PATH, category_table, outline_table
from topicloom.operators.percentile import exact_percentile
from topicloom.plans.clustering import cluster_topics
from topicloom.runtime import materialize


def overlap_scorer(text: Column, category: Column) -> Column:
    """Default pair scorer: share of the category's words found in the text."""
    words = F.array_distinct(F.split(F.lower(category), " "))
    shared = F.array_intersect(words, F.split(F.lower(text), r"\s+"))
    return F.size(shared) / F.size(words)


def rescore_categories(
    df: DataFrame,
    categories: DataFrame,
    pair_scorer: Callable[[Column, Column], Column] = overlap_scorer,
    top_n: int = 5,
    percentile: float = 50,
    std_threshold: float = 0.1,
    match_col: str = "query",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per distinct text: category_id (-1 = outlier), best_score, spread.

    The ``top_n`` most similar categories are scored again as pairs.  The best
    one stands if its score reaches the percentile of all pair scores and the
    scores of the text spread enough.
    """
    texts = df.groupBy(match_col).agg(F.min(vector_col).alias("_vec"))
    short = top_n_categories(texts, categories, top_n, "_vec").drop("_vec")
    named = short.join(categories.select("category_id", "path_text"), "category_id")
    scored = materialize(
        named.select(
            match_col, "category_id", "position",
            pair_scorer(F.col(match_col), F.col("path_text")).cast("double").alias("pair_score"),
        ),
        "pairs",
    )
    threshold = exact_percentile(scored, "pair_score", percentile).scalar()
    best = F.max(F.struct("pair_score", (-F.col("position")).alias("p"), "category_id"))
    per_text = scored.groupBy(match_col).agg(
        best.alias("b"), F.stddev_pop("pair_score").alias("spread")
    )
    good = (F.col("b.pair_score") >= threshold) & (F.col("spread") >= std_threshold)
    return per_text.select(
        match_col,
        F.when(good, F.col("b.category_id")).otherwise(F.lit(-1)).alias("category_id"),
        F.col("b.pair_score").alias("best_score"),
        "spread",
    )


def read_outline(outline: DataFrame | str, spark: SparkSession) -> DataFrame:
    """category_id, path and path_text of an outline given as text or as a table of texts."""
    if isinstance(outline, str):
        outline = spark.createDataFrame([(outline,)], "outline string")
    return category_table(outline_table(outline))


def encode_with_categories(
    df: DataFrame, categories: DataFrame, match_col: str = "query", vector_col: str = "embedding",
    encoder: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows and categories with the vectors of their texts, all from one encoder.

    A row with a null text has a null vector.
    """
    texts = categories.select(F.col("path_text").alias("_text")).unionByName(
        df.select(F.col(match_col).alias("_text")).dropna()
    )
    vectors = materialize(encode_texts(texts.distinct(), "_text", encoder), "text-vectors")
    named = vectors.withColumnRenamed("embedding", vector_col)
    placed = categories.join(vectors, categories["path_text"] == vectors["_text"]).drop("_text")
    rows = df.join(named, df[match_col] == named["_text"], "left").drop("_text")
    return rows, materialize(placed, "categories")


def add_categories(
    df: DataFrame,
    categories: DataFrame | str,
    match_col: str = "query",
    vector_col: str = "embedding",
    cross_encoded: bool = False,
    encoder: Callable | None = None,
    **rescoring,
) -> DataFrame:
    """Add ``category_path``: the path of each row's category.

    ``categories`` is an outline text, or has category_id, path, path_text and
    embedding.  Without vectors on either side, both are encoded by ``encoder``
    (see ``encode_texts``).  Rows without a usable vector, and outliers of the
    rescored form, get the outlier path.  All columns come back as they were;
    only one named ``category_path`` is replaced.
    """
    if rescoring and not cross_encoded:
        raise TypeError(f"only used with cross_encoded: {', '.join(rescoring)}")
    if isinstance(categories, str):
        categories = materialize(read_outline(categories, df.sparkSession), "outline")
    kept = [F.col(f"`{c}`") for c in df.columns if c != "category_path"]
    coded = vector_col in df.columns and "embedding" in categories.columns
    if not coded:
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("category_path", vector_col)]
    rows = df.select(F.struct(*kept).alias("row"), F.col(match_col).alias("query"), *([F.col(vector_col).alias("embedding")] if coded else []))
    if not coded:
        rows, categories = encode_with_categories(rows, categories.drop("embedding"), "query", "embedding", encoder)
    if cross_encoded:
        found = rescore_categories(rows, categories, match_col="query", vector_col="embedding", **rescoring)
        tagged = rows.join(found.select("query", "category_id"), "query", "left")
    else:
        tagged = assign_nearest(rows, categories, "embedding", "embedding")
    paths = categories.select("category_id", "path")
    return tagged.join(paths, "category_id", "left").select("row.*", F.coalesce("path", F.lit(OUTLIER_PATH)).alias("category_path"))


def add_categories_clustered(
    df: DataFrame,
    categories: DataFrame,
    id_col: str = "id",
    match_col: str = "query",
    vector_col: str = "embedding",
    min_cluster_size: int = 5,
    min_samples: int | None = 2,
    reduction_dims: int | float = 2,
    **clustering,
) -> DataFrame:
    """Add ``category_path``: the category nearest to each row's cluster.

    Further options go to ``cluster_topics``.  All columns come back as they
    were; only one named ``category_path`` is replaced.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "category_path"]).alias("row")
    coded = [F.col(vector_col).alias("embedding")] if vector_col in df.columns else []
    out = cluster_topics(
        df.select(kept, F.col(id_col).alias("id"), F.col(match_col).alias("query"), *coded),
        min_cluster_size=min_cluster_size,
        min_samples=min_samples,
        reduction_dims=reduction_dims,
        categories=categories,
        keep_outliers=True,
        **clustering,
    )
    paths = categories.groupBy(F.col("path_text").alias("text_label")).agg(
        F.min("path").alias("category_path")
    )
    return out.join(paths, "text_label", "left").select(
        "row.*", F.coalesce("category_path", F.lit(OUTLIER_PATH)).alias("category_path")
    )
