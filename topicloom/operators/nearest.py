"""Nearest items (categories, centroids) of every row by vector.

The item table is the small side.  It is shipped in blocks of a checked size;
a table that needs several blocks is handled one block at a time, each pass
merging into the running best, so no worker ever holds more than one block.
Rows are never shuffled and only the vector column crosses into Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import materialize

ITEM_BYTES = 64 * 1024 * 1024
_ROUND = 12  # decimals: makes equal vectors tie exactly, whatever the summation order

MATCHES = "array<struct<item:bigint,score:double>>"


def _score_matrix(x: np.ndarray, items: np.ndarray, bias: np.ndarray, metric: str) -> np.ndarray:
    """Lower is better."""
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.round(-(x @ items.T), _ROUND)
    squared = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ items.T) + bias[None, :]
    if metric == "euclidean":
        return np.round(np.sqrt(np.maximum(squared, 0.0)), _ROUND)
    return np.round(squared, _ROUND)


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n lowest scores per row, ties to the lower index."""
    if n == 1:
        return np.argmin(scores, axis=1)[:, None]
    return np.argsort(scores, axis=1, kind="stable")[:, :n]


def _matcher(ids: np.ndarray, vectors: np.ndarray, bias: np.ndarray, n: int, metric: str, spark):
    shared = spark.sparkContext.broadcast((ids, vectors, bias))
    sign = -1.0 if metric == "cosine" else 1.0

    @F.pandas_udf("item array<bigint>, score array<double>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        item_ids, item_vectors, item_bias = shared.value
        for batch in batches:
            found = np.full(len(batch), None, dtype=object)
            scored = np.full(len(batch), None, dtype=object)
            have = np.flatnonzero(batch.notna().to_numpy())
            if not len(item_ids):
                have = have[:0]
            for start in range(0, len(have), 1024):
                rows = have[start : start + 1024]
                x = np.stack(batch.iloc[rows].to_list()).astype(np.float64)
                scores = _score_matrix(x, item_vectors, item_bias, metric)
                best = _top(scores, n)
                values = np.take_along_axis(scores, best, axis=1)
                for r, row in enumerate(rows):
                    if not np.isnan(values[r, 0]):
                        found[row] = item_ids[best[r]]
                        scored[row] = sign * values[r]
            yield pd.DataFrame({"item": found, "score": scored})

    def matches(vector: Column) -> Column:
        both = match(vector)
        return F.arrays_zip(both["item"].alias("item"), both["score"].alias("score")).cast(MATCHES)

    return matches


def match_items(
    df: DataFrame,
    vector_col: str,
    items: DataFrame,
    n: int = 1,
    metric: str = "cosine",
    out_col: str = "matches",
    block_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Add the ``n`` best items per row as array<struct<item, score>>, best first.

    ``items`` has item (long), vector and, for ``biased`` scores, bias.
    Metrics: ``cosine`` (zero vectors match nothing), ``euclidean``, and
    ``biased`` = |x|^2 - 2 x.v + bias.  Ties go to the lowest item id.
    """
    spark = df.sparkSession
    usable = items.where(F.col("vector").isNotNull())
    if "bias" not in usable.columns:
        usable = usable.withColumn("bias", F.lit(None).cast("double"))
    shape = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, math.ceil(shape["n"] * ((shape["d"] or 0) + 2) * 8 / block_bytes))
    out = df.withColumn(out_col, F.lit(None).cast(MATCHES))
    for b in range(blocks):
        part = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = part.select("item", "vector", "bias").orderBy("item").collect()  # one bounded block
        ids = np.array([r["item"] for r in rows], dtype=np.int64)
        vectors = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), shape["d"] or 1)
        bias = np.array([np.nan if r["bias"] is None else r["bias"] for r in rows], dtype=np.float64)
        if metric == "cosine":
            keep = np.linalg.norm(vectors, axis=1) > 0
            ids, vectors, bias = ids[keep], vectors[keep], bias[keep]
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        elif metric == "euclidean":
            bias = (vectors * vectors).sum(axis=1)
        found = _matcher(ids, vectors, bias, n, metric, spark)(F.col(vector_col))
        if blocks == 1:
            return df.withColumn(out_col, found)
        out = out.withColumn(out_col, _merge_best(F.col(out_col), found, n, metric))
        if b + 1 < blocks:
            out = materialize(out, "nearest")
    return out


def _merge_best(a: Column, b: Column, n: int, metric: str) -> Column:
    sign = -1.0 if metric == "cosine" else 1.0
    none = F.array().cast(MATCHES)
    both = F.concat(F.coalesce(a, none), F.coalesce(b, none))
    keyed = F.transform(
        both, lambda m: F.struct((m["score"] * sign).alias("k"), m["item"].alias("item"), m["score"].alias("score"))
    )
    best = F.slice(F.array_sort(keyed), 1, n)
    merged = F.transform(best, lambda m: F.struct(m["item"].alias("item"), m["score"].alias("score")))
    return F.when(F.size(both) > 0, merged)


def assign_nearest(
    df: DataFrame,
    categories: DataFrame,
    vector_col: str = "embedding",
    category_vector: str = "embedding",
    metric: str = "cosine",
) -> DataFrame:
    """Add category_id and similarity of the nearest category; null for zero vectors."""
    items = categories.select(
        F.col("category_id").cast("long").alias("item"), F.col(category_vector).alias("vector")
    )
    out = match_items(df, vector_col, items, 1, metric, "_m")
    name = "similarity" if metric == "cosine" else "distance"
    return out.select(
        *df.columns,
        F.get("_m", F.lit(0))["item"].alias("category_id"),
        F.get("_m", F.lit(0))["score"].alias(name),
    )


def top_n_categories(
    df: DataFrame,
    categories: DataFrame,
    n: int = 5,
    vector_col: str = "embedding",
    category_vector: str = "embedding",
) -> DataFrame:
    """One row per row and category for the ``n`` most similar ones, with position."""
    items = categories.select(
        F.col("category_id").cast("long").alias("item"), F.col(category_vector).alias("vector")
    )
    out = match_items(df, vector_col, items, n, "cosine", "_m")
    return out.select(*df.columns, F.posexplode("_m").alias("_p", "_x")).select(
        *df.columns,
        (F.col("_p") + 1).alias("position"),
        F.col("_x.item").alias("category_id"),
        F.col("_x.score").alias("similarity"),
    )
