"""Centroids, cluster statistics and per-row silhouettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.vectors import dot
from topicloom.operators.knn import CellTable, Near, Tile
from topicloom.operators.nearest import assign_nearest, match_items
from topicloom.runtime import BROADCAST_BYTES, materialize

#: Rows on a side of one block of distances, and how many are taken at once.
BLOCK_ROWS, STRIPE = 2048, 256
#: Clusters looked at per row at first.
NEAREST_CLUSTERS = 64
#: Clusters, at most, whose distances are summed in tiles that travel for all of them at once.
FEW_CLUSTERS = 64
SLACK = 1e-9

def mean_vector(vector_col: str):
    """Aggregate: mean of an array column, partially aggregated per task."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector_col).cast("array<double>"))))


def centroids(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Mean vector per label: label, centroid, size."""
    return (
        df.where(F.col(vector_col).isNotNull())
        .groupBy(label_col)
        .agg(mean_vector(vector_col).alias("centroid"), F.count(F.lit(1)).alias("size"))
    )


def silhouette_rows(
    df: DataFrame, label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Add ``silhouette`` per row in its squared-Euclidean form.

    The mean squared distance from x to a cluster is |x|^2 - 2 x.m + q, with m
    the cluster's mean and q its mean squared norm, so no pairs are formed.
    A row alone in its cluster gets 0; with a single cluster it is null.
    """
    vec = F.col(vector_col).cast("array<double>")
    sized = df.withColumn("_sq", dot(vec, vec))
    stats = materialize(
        sized.groupBy(label_col).agg(
            mean_vector(vector_col).alias("vector"),
            F.avg("_sq").alias("bias"),
            F.count(F.lit(1)).alias("_size"),
        ),
        "clusters",
    )
    items = stats.select(F.col(label_col).cast("long").alias("item"), "vector", "bias")
    near = match_items(sized, vector_col, items, 2, "biased", "_m")
    own = stats.select(label_col, F.col("vector").alias("_mean"), F.col("bias").alias("_q"), "_size")
    label = F.col(label_col).cast("long")
    other = F.filter("_m", lambda m: m["item"] != label)
    n = F.col("_size")
    to_own = F.col("_sq") - 2 * dot(vec, F.col("_mean")) + F.col("_q")
    a = F.greatest(F.try_divide(to_own * n, n - 1), F.lit(0.0))
    nearest = F.get(other, F.lit(0))["score"]
    b = F.greatest(nearest, F.lit(0.0))
    value = F.when(n == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    return near.join(own, label_col).select(
        *df.columns, F.when(nearest.isNotNull(), value).alias("silhouette")
    )


def _distance_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sum of the distances of each row of ``left`` to all rows of ``right``."""
    if left.empty or right.empty:
        return pd.DataFrame({"_row": [], "item": [], "total": []})
    x, y = np.stack(left["_vec"].to_list()), np.stack(right["_vec2"].to_list())
    squared, totals = (y * y).sum(axis=1), []
    for at in range(0, len(x), STRIPE):
        own = x[at : at + STRIPE]
        apart = (own * own).sum(axis=1)[:, None] + squared - 2 * (own @ y.T)
        totals.append(np.sqrt(np.maximum(apart, 0)).sum(axis=1))
    return pd.DataFrame({"_row": left["_row"], "item": left["item"], "total": np.concatenate(totals)})


def _tile_sums(left: Tile, right: Tile, parts) -> pd.DataFrame:
    """Sum of the distances of each row of a tile to the other tile's rows of each cluster, both ways."""
    near, same, out = Near(left, right), left.number == right.number, []
    for rows, cols in parts:
        cols = cols[np.argsort(right.cells[cols], kind="stable")]
        theirs, first = np.unique(right.cells[cols], return_index=True)
        by_row = np.argsort(left.cells[rows], kind="stable")
        rows = rows[by_row]
        mine = np.unique(left.cells[rows])
        down, across = np.zeros((len(rows), len(theirs))), np.zeros((len(cols), len(mine)))
        at = 0
        for own, squared in near.stripes(rows, cols, np.float64):
            apart = np.sqrt(np.maximum(squared, 0.0, out=squared), out=squared)
            down[at : at + len(own)] = np.add.reduceat(apart, first, axis=1)
            if not same:
                here, start = np.unique(left.cells[own], return_index=True)
                across[:, np.searchsorted(mine, here)] += np.add.reduceat(apart, start, axis=0).T
            at += len(own)
        ways = [(left.ids[rows], theirs, down)] if same else [(left.ids[rows], theirs, down), (right.ids[cols], mine, across)]
        for ids, cells, sums in ways:
            out.append(pd.DataFrame({"_row": np.repeat(ids, len(cells)), "cell": np.tile(cells, len(ids)), "total": sums.ravel()}))
    return pd.concat(out) if out else pd.DataFrame({"_row": [], "cell": [], "total": []})


def _sums_by_tiles(rows: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """_row, item, total for few clusters: tiles of whole clusters, or parts of one, meet once for both sides."""
    named = stats.orderBy("item").select("item", "size", "vector").collect()  # at most FEW_CLUSTERS rows
    spark = rows.sparkSession
    cells = spark.createDataFrame([(r["item"], i) for i, r in enumerate(named)], "item long, cell int")
    placed = rows.join(F.broadcast(cells), "item").select(F.col("_row").alias("id"), F.col("_vec").alias("vec"), "cell")
    table = CellTable.of_cells(materialize(placed, "placed"), [(i, r["size"], r["vector"]) for i, r in enumerate(named)])
    own = rows.select("_row", F.col("item").alias("own"))
    met = asked.join(own, "_row").select("own", "item").distinct().collect()  # pairs of such clusters
    spot = {r["item"]: i for i, r in enumerate(named)}
    close = np.zeros((len(named), len(named)), dtype=bool)
    for r in met:
        close[spot[r["own"]], spot[r["item"]]] = True
    sums = table.visit(table.pack(), close, _tile_sums, "_row long, cell int, total double")
    whole = sums.groupBy("_row", "cell").agg(F.sum("total").alias("total"))
    return whole.join(F.broadcast(cells), "cell").join(asked, ["_row", "item"]).select("_row", "item", "total")


def _worth_summing(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """_row, item: each row's own cluster, and the others that may be its nearest one.

    The mean distance to a cluster is at least the distance to its centre and
    at most the root of the mean squared distance.  A cluster whose centre is
    farther than the least such root cannot be the nearest.
    """
    clusters, n = stats.count(), NEAREST_CLUSTERS
    scatter = stats.select("item", (F.col("bias") - dot(F.col("vector"), F.col("vector"))).alias("scatter"))
    while True:
        near = match_items(rows, "_vec", stats.select("item", "vector"), min(n, clusters), "euclidean", "_m")
        listed = near.select("_row", F.col("item").alias("own"), F.posexplode("_m").alias("at", "m"))
        listed = listed.select("_row", "own", "at", "m.item", F.col("m.score").alias("apart")).join(scatter, "item")
        most = F.when(F.col("item") != F.col("own"), F.sqrt(F.greatest(F.pow("apart", F.lit(2.0)) + F.col("scatter"), F.lit(0.0))))
        listed = materialize(listed.withColumn("most", most), "clusters-near")
        bound = listed.groupBy("_row").agg(F.min("most").alias("bound"), F.max("apart").alias("reach"))
        if n >= clusters or not bound.where("bound IS NULL OR reach <= bound").limit(1).count():
            break
        n *= 4
    chosen = listed.join(bound, "_row").where((F.col("item") != F.col("own")) & (F.col("apart") <= F.col("bound") + SLACK))
    return chosen.select("_row", "item").unionByName(rows.select("_row", "item"))


def _sums_by_blocks(rows: DataFrame, stats: DataFrame, asked: DataFrame, block_rows: int) -> DataFrame:
    """_row, item, total for many clusters, in blocks of the rows that ask for one."""
    sizes = asked.groupBy("item").agg(F.count(F.lit(1)).alias("asking")).join(stats.select("item", "size"), "item")
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    sizes = materialize(sizes.select("item", blocks("asking").alias("a"), blocks("size").alias("b")), "blocks")
    if sizes.count() * 32 <= BROADCAST_BYTES:
        sizes = F.broadcast(sizes)
    spot = lambda n: F.pmod(F.xxhash64("_row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "item").select("_row", "item", spot("a").alias("i"), every("b").alias("j"))
    left = left.join(rows.select("_row", "_vec"), "_row")
    right = rows.join(sizes, "item").select(F.col("item").alias("item2"), F.col("_vec").alias("_vec2"), spot("b").alias("j2"), every("a").alias("i2"))
    met = left.groupBy("item", "i", "j").cogroup(right.groupBy("item2", "i2", "j2"))
    return met.applyInPandas(_distance_sums, "_row long, item long, total double")


def euclidean_silhouette_rows(
    df: DataFrame, label_col: str = "label", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``silhouette`` per row from mean distances.

    Distances are summed between a row and whole clusters only where bounds by
    the centres leave the cluster in question: for up to ``FEW_CLUSTERS``
    clusters in tiles, a row sent about as often as there are tiles; for more in
    blocks of at most ``block_rows`` rows a side.  Tasks give one sum per row
    and cluster.  A row alone in its cluster gets 0; with a single cluster, or
    without a vector or a label, it is null.
    """
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    vec = F.col(vector_col).cast("array<double>").alias("_vec")
    rows = numbered.select("_row", F.col(label_col).cast("long").alias("item"), vec).where("item IS NOT NULL AND _vec IS NOT NULL")
    squared = dot(F.col("_vec"), F.col("_vec"))
    stats = rows.groupBy("item").agg(mean_vector("_vec").alias("vector"), F.avg(squared).alias("bias"), F.count(F.lit(1)).alias("size"))
    stats = materialize(stats, "clusters")
    asked = materialize(_worth_summing(rows, stats), "asked")
    if 0 < stats.count() <= FEW_CLUSTERS:
        sums = _sums_by_tiles(rows, stats, asked)
    else:
        sums = _sums_by_blocks(rows, stats, asked, block_rows)
    whole = sums.groupBy("_row", "item").agg(F.sum("total").alias("total")).join(stats.select("item", "size"), "item")
    own = rows.select("_row", F.col("item").alias("own"))
    inside = F.col("item") == F.col("own")
    means = whole.join(own, "_row").groupBy("_row").agg(
        F.max(F.when(inside, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("size"))).alias("b"),
    )
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    told = means.select("_row", F.when(F.col("b").isNotNull(), value).alias("silhouette"))
    return numbered.join(told, "_row", "left").select(*[F.col(f"`{c}`") for c in df.columns], "silhouette")


def assign_outliers(
    df: DataFrame,
    label_col: str = "label",
    vector_col: str = "embedding",
    gate: str = "none",
) -> DataFrame:
    """Give rows labelled -1 the label of the nearest centroid.

    The centroid of the outliers takes part, so some rows stay -1.  Nothing
    changes when all outliers would get the same label.  ``gate="silhouette"``
    keeps only assignments whose silhouette among the outliers is positive;
    ``"squared"`` takes the silhouette of squared distances, which needs no
    pairs of rows.
    """
    if gate not in GATES:
        raise ValueError(f"unknown gate: {gate}")
    centers = centroids(df, label_col, vector_col).select(
        F.col(label_col).cast("long").alias("category_id"), F.col("centroid")
    )
    out = materialize(
        assign_nearest(
            df.where(F.col(label_col) == -1), centers, vector_col, "centroid", "euclidean"
        ).drop("distance"),
        "outliers",
    )
    kept = df.where(~F.col(label_col).eqNullSafe(-1))
    if out.select("category_id").where("category_id is not null").distinct().limit(2).count() < 2:
        return kept.unionByName(out.drop("category_id"))
    new_label = F.col("category_id")
    if gate != "none":
        out = GATES[gate](out, "category_id", vector_col)
        new_label = F.when(F.col("silhouette") > 0, new_label).otherwise(F.col(label_col))
    # a row without a usable vector has no nearest centroid and stays an outlier
    new_label = F.coalesce(new_label, F.col(label_col))
    moved = out.withColumn(label_col, new_label.cast(df.schema[label_col].dataType))
    return kept.unionByName(moved.select(*df.columns))


GATES = {"none": None, "silhouette": euclidean_silhouette_rows, "squared": silhouette_rows}


def label_stats(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of distinct labels and of outlier rows."""
    return df.agg(
        F.count_distinct(label_col).alias("labels"),
        F.count_if(F.col(label_col) == -1).alias("outliers"),
    )
