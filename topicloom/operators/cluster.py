"""Clustering: density, hierarchical, and the outlier steps around them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.vectors import l2_normalize, norm
from topicloom.operators.components import connected_components
from topicloom.operators.knn import CellTable, Near, Tile, close_pairs_forest, knn_distance_curve, knn_graph
from topicloom.operators.rank import global_rank, knee_points
from topicloom.runtime import BROADCAST_BYTES, materialize

RANDOM_SEED = 42
DEFAULT_EPSILON = 0.5
#: Groups that Ward merging takes to the driver; more are merged round by round in Spark.
WARD_LOCAL = 4096
#: Above any Ward cost, yet finite: no group is its own nearest one.
ANY_COST = float(np.finfo(np.float64).max)
WARD_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_min_samples(min_cluster_size: int) -> int:
    return round(math.sqrt(min_cluster_size))


def unit_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Scale vectors to length 1; a zero vector becomes null."""
    vec = F.col(vector_col)
    return df.withColumn(vector_col, F.when(norm(vec) > 0, l2_normalize(vec)))


def reduce_vectors(df: DataFrame, dims: int | float, vector_col: str = "embedding") -> DataFrame:
    """Project vectors by PCA to ``dims`` numbers, or to that share of their size."""
    if dims <= 0:
        return df
    have = df.where(F.col(vector_col).isNotNull())
    if isinstance(dims, float):
        dims = math.ceil(have.select(F.size(vector_col).alias("d")).first()["d"] * dims)
    ready = have.withColumn("_in", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = PCA(k=int(dims), inputCol="_in", outputCol="_out").fit(ready)
    return model.transform(ready).withColumn(vector_col, vector_to_array("_out")).drop("_in", "_out")


def estimate_epsilon(
    df: DataFrame, min_samples: int, id_col: str = "id", vector_col: str = "embedding",
    use_elbow: bool = True, neighbors: DataFrame | None = None,
) -> float:
    """Distance at the elbow of the sorted neighbour-distance curve.

    The mean distance when there is no elbow or it is at 0; 0.5 when off.
    ``neighbors`` may pass the written ``knn_graph`` for ``min_samples``.
    """
    if not use_elbow:
        return DEFAULT_EPSILON
    if neighbors is None:
        neighbors = knn_graph(df, min_samples, id_col, vector_col)
    curve = materialize(knn_distance_curve(neighbors, min_samples), "curve")
    elbow = knee_points(
        curve, "distance", [1.0], order=[F.desc("distance"), F.desc("rank")]
    ).first()["score"]
    return float(elbow) if elbow else float(curve.agg(F.avg("distance")).first()[0] or 0.0)


def _dense_labels(members: DataFrame, min_size: int) -> DataFrame:
    """node, label: components of at least ``min_size`` numbered by smallest node."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.where(F.col("n") >= min_size).select("component")
    numbered = global_rank(big, [F.asc("component")], "_label")
    return members.join(numbered, "component").select(
        "node", (F.col("_label") - 1).cast("int").alias("label")
    )


def density_cluster(
    df: DataFrame,
    epsilon: float,
    min_samples: int,
    min_cluster_size: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int | None = None,
    neighbors: DataFrame | None = None,
) -> DataFrame:
    """Label dense groups, -1 for the rest.

    Rows whose ``min_samples``-th neighbour (themselves included) lies within
    ``epsilon`` are linked when they are within ``epsilon`` of each other; the
    connected groups of at least ``min_cluster_size`` rows are the clusters.
    This is the flat cut of the mutual-reachability hierarchy at ``epsilon``.
    ``neighbors`` may pass the written ``knn_graph`` for ``min_samples``.
    """
    stored = materialize(df, "vectors")
    if neighbors is None:
        neighbors = knn_graph(stored, min_samples, id_col, vector_col, block_rows)
    core = neighbors.where(
        (F.col("position") == min_samples) & (F.col("distance") <= epsilon)
    )
    dense = materialize(
        core.select("id").join(
            stored.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")), "id"
        ),
        "dense",
    )
    links = close_pairs_forest(dense, epsilon, "id", "vec", block_rows)
    found = connected_components(links)
    alone = dense.select(F.col("id").alias("node")).join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    labels = _dense_labels(materialize(alone, "members"), min_cluster_size)
    return _attach(stored, labels, id_col, label_col)


def threshold_cluster(
    df: DataFrame, limit: float, id_col: str = "id", vector_col: str = "embedding",
    label_col: str = "label", block_rows: int | None = None,
) -> DataFrame:
    """Label the groups linked by distances up to ``limit`` (single-linkage cut)."""
    stored = materialize(df, "vectors")
    found = connected_components(close_pairs_forest(stored, limit, id_col, vector_col, block_rows))
    members = stored.select(F.col(id_col).cast("long").alias("node")).join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    return _attach(stored, _dense_labels(materialize(members, "members"), 1), id_col, label_col)


def _attach(df: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    named = labels.select(F.col("node").alias(id_col), F.col("label").alias("_label"))
    base = df.drop(label_col) if label_col in df.columns else df
    return base.join(named, id_col, "left").withColumn(
        label_col, F.coalesce("_label", F.lit(-1))
    ).drop("_label")


def ward_chain(sizes: np.ndarray, centers: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(kept, lost, cost) of all Ward merges that cost at most ``threshold``, inner ones before outer ones.

    A chain of nearest neighbours ends in a pair that are each other's nearest;
    Ward merging may take such pairs in any order.  A group whose nearest one
    costs more than the threshold takes no further part.
    """
    sizes, centers, merges = sizes.astype(float).copy(), centers.astype(float).copy(), []
    alive, chain = np.ones(len(sizes), dtype=bool), []
    while alive.any():
        a = chain[-1] if chain else int(alive.argmax())
        gaps = centers - centers[a]
        cost = np.sqrt(2 * sizes[a] * sizes / (sizes[a] + sizes) * np.einsum("ij,ij->i", gaps, gaps))
        cost[~alive] = cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
        if not cost[b] <= threshold:
            alive[a], chain = False, chain[:-1]
        elif len(chain) > 1 and b == chain[-2]:
            centers[a] = (sizes[a] * centers[a] + sizes[b] * centers[b]) / (sizes[a] + sizes[b])
            sizes[a] += sizes[b]
            merges.append((a, b, float(cost[b])))
            alive[b], chain = False, chain[:-2]
        else:
            chain = [*(chain or [a]), b]
    return merges


def ward_merges(sizes: np.ndarray, centers: np.ndarray, threshold: float) -> np.ndarray:
    """Group number of each centre after all Ward merges that cost at most ``threshold``."""
    group = np.arange(len(sizes))
    for a, b, _ in ward_chain(sizes, centers, threshold):
        group[group == b] = a
    return np.unique(group, return_inverse=True)[1]


def _nearest_groups(groups: DataFrame, threshold: float) -> DataFrame:
    """id, other, cost: the nearest group by Ward cost of each group that has one within ``threshold``.

    Costs are no less than distances, so cells farther apart are not visited.
    """

    def nearest(left: Tile, right: Tile, parts) -> pd.DataFrame:
        near, n, m = Near(left, right), left.extra, right.extra
        ids, others = left.ids, right.ids
        low = [np.full(len(ids), np.inf), np.full(len(others), np.inf)]
        found = []

        def keep(way: int, own: np.ndarray, cols: np.ndarray, costs: np.ndarray) -> None:
            least = costs.min(axis=1)
            ask = np.flatnonzero((least <= low[way][own]) & (least <= threshold) & (least < np.inf))
            low[way][own[ask]] = least[ask]
            r, c = np.nonzero(costs[ask] == least[ask, None])
            mine, theirs = ((ids, others), (others, ids))[way]
            a, b = mine[own[ask[r]]], theirs[cols[c]]
            first, second = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
            tie = (((first * WARD_MIX) ^ second) * WARD_MIX >> np.uint64(1)).astype(np.int64)
            found.append(pd.DataFrame({"id": a, "other": b, "cost": least[ask[r]], "tie": tie}))

        def best() -> pd.DataFrame:
            return pd.concat(found).sort_values(["id", "cost", "tie", "other"]).drop_duplicates("id")

        for rows, cols in parts:
            for own, squared in near.stripes(rows, cols, np.float64):
                cost = np.sqrt(np.maximum(squared, 0) * (2 * n[own, None] * m[cols][None] / (n[own, None] + m[cols][None])))
                cost[ids[own, None] == others[cols][None]] = np.inf
                keep(0, own, cols, cost)
                if left.number != right.number:
                    keep(1, cols, own, cost.T)
                if len(found) > 256:
                    found[:] = [best()]
        return best() if found else pd.DataFrame({"id": [], "other": [], "cost": [], "tie": []})

    table = CellTable(groups, "id", "vec", None)
    weights = groups.select("id", F.col("n").alias("extra"))
    found = table.visit(table.pack(weights), table.close(threshold), nearest, "id long, other long, cost double, tie long")
    best = found.groupBy("id").agg(F.min(F.struct("cost", "tie", "other")).alias("b"))
    return best.select("id", "b.other", "b.cost")


def _ward_round(groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups after merging all pairs that are each other's nearest, those pairs with their cost, and id -> into."""
    near = materialize(_nearest_groups(groups, threshold), "nearest")
    back = near.select(F.col("other").alias("id"), F.col("id").alias("_back"))
    pairs = near.join(back, "id").where("_back = other AND id < other").select("id", "other", "cost")
    pairs = materialize(pairs, "merges")
    if not pairs.limit(1).count():  # rounding hides the pair of least cost, or there is none
        pairs = near.orderBy("cost", "id").limit(1).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "cost")
    lost = pairs.select(F.col("other").alias("id"), F.col("id").alias("_into"))
    step = materialize(near.select("id").join(lost, "id", "left").select("id", F.coalesce("_into", "id").alias("into")), "step")
    center = vector_to_array(Summarizer.mean(array_to_vector("vec"), F.col("n").cast("double")))
    merged = groups.join(step, "id").groupBy("into").agg(F.sum("n").alias("n"), center.alias("vec"))
    return materialize(merged.select(F.col("into").alias("id"), "n", "vec"), "groups"), pairs, step


def ward_groups(nodes: DataFrame, threshold: float) -> DataFrame:
    """id, component: the smallest id of each node's group; ``nodes`` has id, n and vec.

    In each round every group finds its nearest one, and all pairs that are
    each other's nearest merge.  Groups with none within ``threshold`` are
    complete.  What fits ``WARD_LOCAL`` rows is merged on the driver.
    """
    groups, steps = materialize(nodes.select("id", "n", "vec"), "groups"), []
    while groups.count() > WARD_LOCAL:
        groups, _, step = _ward_round(groups, threshold)
        steps.append(step)
    rest = groups.orderBy("id").collect()
    number = ward_merges(np.array([r["n"] for r in rest]), np.array([r["vec"] for r in rest]), threshold) if rest else []
    first: dict[int, int] = {}
    named = [(r["id"], first.setdefault(int(g), r["id"])) for r, g in zip(rest, number)]
    out = nodes.sparkSession.createDataFrame(named, "into long, component long")
    for step in reversed(steps):  # at most two groups of a step go into the same one
        out = step.join(out, "into", "left").select(F.col("id").alias("into"), F.coalesce("component", "into").alias("component"))
        out = materialize(out, "named")
    own = nodes.select(F.col("id").alias("into")).join(out, "into", "left")
    return own.select(F.col("into").alias("id"), F.coalesce("component", "into").alias("component"))


def ward_tree(nodes: DataFrame) -> DataFrame:
    """id, other, cost, place: every merge of the Ward tree of ``nodes`` (id, n, vec).

    A merge joins the groups whose smallest ids are id and other, or once
    belonged to them; ``place`` is higher the farther out a merge lies.  All
    pairs that are each other's nearest merge in one round, so merges do not
    come by cost, but an outer one never costs less than those inside it.
    """
    groups, merges = materialize(nodes.select("id", "n", "vec"), "groups"), []
    while groups.count() > WARD_LOCAL:
        groups, pairs, _ = _ward_round(groups, ANY_COST)
        merges.append(pairs.withColumn("place", F.lit(len(merges)).cast("long")))
    rest = groups.orderBy("id").collect()
    chain = ward_chain(np.array([r["n"] for r in rest]), np.array([r["vec"] for r in rest]), ANY_COST) if rest else []
    local = [(rest[a]["id"], rest[b]["id"], cost, len(merges) + at) for at, (a, b, cost) in enumerate(chain)]
    out = nodes.sparkSession.createDataFrame(local, "id long, other long, cost double, place long")
    for pairs in merges:
        out = out.unionByName(pairs)
    return out


def cut_tree(nodes: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """id, component: ``k`` groups, or as many as there are nodes, left by undoing the k - 1 costliest merges."""
    stored = materialize(tree, "tree")
    undone = stored.orderBy(F.desc("cost"), F.desc("place")).limit(k - 1).select("id", "other")
    kept = stored.join(F.broadcast(undone) if k * 16 < BROADCAST_BYTES else undone, ["id", "other"], "left_anti")
    found = connected_components(kept, "id", "other").withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def ward_cluster(
    df: DataFrame, threshold: float | None = None, id_col: str = "id", vector_col: str = "embedding",
    label_col: str = "label", k: int | None = None,
) -> DataFrame:
    """Groups of least variance growth: merging goes on while its Ward cost is at most ``threshold``, or down to ``k`` groups.

    Both cuts are exact and give any number of groups, numbered by their
    smallest id.  Rows of equal vectors start as one group.
    """
    base = df.drop(label_col) if label_col in df.columns else df
    stored = materialize(base.withColumn("_vec", F.col(vector_col).cast("array<double>")), "rows")
    distinct = stored.groupBy("_vec").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("_first"))
    named = materialize(global_rank(distinct, [F.asc("_first"), F.asc("_vec")], "_node"), "nodes")
    nodes = named.select(F.col("_node").cast("long").alias("id"), "n", F.col("_vec").alias("vec"))
    found = ward_groups(nodes, threshold) if k is None else cut_tree(nodes, ward_tree(nodes), k)
    labels = _dense_labels(materialize(found.select(F.col("id").alias("node"), "component"), "members"), 1)
    names = named.join(labels, named["_node"] == labels["node"]).select("_vec", F.col("label").alias(label_col))
    names = materialize(names, "ward-labels")
    size = names.agg(F.sum(F.size("_vec") * 8 + 64).alias("b")).first()["b"] or 0
    return stored.join(F.broadcast(names) if size < BROADCAST_BYTES else names, "_vec").drop("_vec")


def bisecting_cluster(df: DataFrame, k: int, vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``k`` groups by top-down bisecting: not exact, for tables too large to merge."""
    base = df.drop(label_col) if label_col in df.columns else df
    ready = base.withColumn("_in", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = BisectingKMeans(k=k, seed=RANDOM_SEED, featuresCol="_in", predictionCol=label_col).fit(ready)
    return model.transform(ready).drop("_in")


def hierarchical_cluster(
    df: DataFrame,
    k: int | None = None,
    distance_threshold: float | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Ward groups: ``k`` of them, or those under a cost threshold."""
    if (k is None) == (distance_threshold is None):
        raise ValueError("give either k or distance_threshold")
    return ward_cluster(df, distance_threshold, id_col, vector_col, label_col, k)


def recluster_outliers(
    df: DataFrame,
    k: int | None = None,
    distance_threshold: float | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Group the rows still labelled -1 by their unit vectors; new labels follow the highest one.

    Rows without a usable vector stay -1.
    """
    stored = materialize(df, "labelled")
    out = unit_vectors(stored.where(F.col(label_col) == -1).withColumn("_unit", F.col(vector_col)), "_unit")
    usable = out.where(F.col("_unit").isNotNull())
    if usable.limit(1).count() == 0:
        return stored
    top = stored.select((F.max(label_col) + 1).alias("v")).scalar()
    redone = hierarchical_cluster(usable, k, distance_threshold, id_col, "_unit", label_col)
    redone = redone.withColumn(label_col, (F.col(label_col) + top).cast("int"))
    rest = out.where(F.col("_unit").isNull()).select(*stored.columns)
    kept = stored.where(~F.col(label_col).eqNullSafe(-1))
    return kept.unionByName(redone.select(*stored.columns)).unionByName(rest)
