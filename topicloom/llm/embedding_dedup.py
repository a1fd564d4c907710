"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors within cosine t are within squared distance d = 2 - 2t.  After a
fixed random rotation they are split into blocks of coordinates; each block has
a share of d in proportion to its dimensions, and of a close pair at least one
block is within its share.  Each block is range-joined: vectors are put into
grid cells over its first coordinates, as wide as the share's root, and a cell
meets itself and the neighbours after it.  Pairs within a block's share are
verified exactly, by cosine in double precision.  A pair counts in the first
block that finds it, so links are never counted twice.

Only distinct vectors of a label are joined; copies are counted beside them.
Cells above ``TILE`` vectors are dealt out in tiles, so no task gets a whole
hot cell.  A tile returns counts of links and a spanning forest of its linked
pairs, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing.  Vectors of
different lengths do not link.  Repeated rows are copies and link with each
other.  A null id takes part and never is a component's id unless the component
has no other.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import broadcast_if_small
from topicloom.operators.components import connected_components
from topicloom.runtime import materialize

COSINE = 0.93
BLOCKS = 4
#: Vectors on a side of one tile.
TILE = 1024
ROWS_AT_ONCE = 256
SEED = 93
SLACK = 1e-9

CELL = ["label", "dim", "block", "x", "y"]
# Neighbours before a cell, where its vectors are visitors.
BEFORE = ((-1, -1), (-1, 0), (-1, 1), (0, -1))


_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """Orthogonal matrix, the same in every process."""
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]
    return _rotations[dim]


def block_slices(dim: int) -> list[slice]:
    n = min(BLOCKS, dim)
    return [slice(dim * i // n, dim * (i + 1) // n) for i in range(n)]


def shares(dim: int, cosine: float) -> list[float]:
    """Squared distance that each block may have."""
    return [(2 - 2 * cosine) * (s.stop - s.start) / dim + SLACK for s in block_slices(dim)]


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and their rotated unit vectors."""
    raw = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return raw, unit @ rotation(raw.shape[1])


def _cells(cosine: float):
    @F.pandas_udf("array<struct<block:int,x:long,y:long>>")
    def cells(vectors: pd.Series) -> pd.Series:
        out, sizes = [[] for _ in range(len(vectors))], vectors.map(len).to_numpy()
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            turned = _unit(vectors.iloc[rows].tolist())[1]
            for b, (part, share) in enumerate(zip(block_slices(dim), shares(dim, cosine))):
                at = np.floor(turned[:, part][:, :2] / np.sqrt(share)).astype(np.int64)
                for row, place in zip(rows.tolist(), at.tolist()):
                    out[row].append({"block": b, "x": place[0], "y": place[1] if len(place) > 1 else 0})
        return pd.Series(out)

    return cells


def _tile(cosine: float):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        block, role = int(group["block"].iloc[0]), group["role"].to_numpy()
        raw, turned = _unit(group["embedding"].tolist())
        uid, copies = group["uid"].to_numpy(), group["copies"].to_numpy()
        norm = np.linalg.norm(raw, axis=1)
        parts, limit = block_slices(raw.shape[1]), shares(raw.shape[1], cosine)
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        visitor = group["visitor"].to_numpy()[right]
        z = turned[:, parts[block]]
        square = (z * z).sum(axis=1)
        degree = np.zeros(len(uid), dtype=np.int64)
        parent = list(range(len(uid)))
        edges = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(left), ROWS_AT_ONCE):
            own = left[at : at + ROWS_AT_ONCE]
            apart = square[own][:, None] + square[right] - 2 * (z[own] @ z[right].T)
            close = (apart <= limit[block]) & (visitor | (uid[own][:, None] < uid[right]))
            i, j = np.nonzero(close)
            i, j = own[i], right[j]
            for b in range(block):  # found there already
                fresh = ((turned[i, parts[b]] - turned[j, parts[b]]) ** 2).sum(axis=1) > limit[b]
                i, j = i[fresh], j[fresh]
            near = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= cosine
            i, j = i[near], j[near]
            np.add.at(degree, i, copies[j])
            np.add.at(degree, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[b] = a
                    edges.append((a, b))
        linked = np.flatnonzero(degree)
        return pd.DataFrame(
            {
                "a": [*uid[linked], *(uid[a] for a, _ in edges)],
                "b": [*([None] * len(linked)), *(uid[b] for _, b in edges)],
                "n": [*degree[linked], *([0] * len(edges))],
            }
        )

    return links


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(label_col).isNotNull() & F.coalesce(~odd & F.exists(vector_col, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"), usable.alias("usable"))
    distinct = rows.where("usable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    distinct = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")

    placed = distinct.select("uid", "label", F.size("embedding").alias("dim"), F.explode(_cells(cosine)("embedding")).alias("c"))
    placed = materialize(placed.select("uid", "label", "dim", "c.block", "c.x", "c.y"), "cells")
    home = placed.withColumn("visitor", F.lit(False))
    shifts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in BEFORE])
    visits = placed.withColumn("s", F.explode(shifts)).select(
        "uid", "label", "dim", "block", (F.col("x") + F.col("s.x")).alias("x"), (F.col("y") + F.col("s.y")).alias("y"), F.lit(True).alias("visitor")
    )
    there = home.unionByName(visits)
    counts = there.groupBy(*CELL).agg(F.count_if(~F.col("visitor")).alias("home"), F.count(F.lit(1)).alias("all")).where("home > 0")
    counts = counts.withColumn("lefts", F.ceil(F.col("home") / tile).cast("int")).withColumn("rights", F.ceil(F.col("all") / tile).cast("int"))
    counts = materialize(counts.select(*CELL, "lefts", "rights"), "counts")
    dealt = there.join(broadcast_if_small(counts, 64), CELL)
    spot = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = F.col("rights") == 1
    keep = [*CELL, "uid", "visitor"]
    both = dealt.where(one & ~F.col("visitor")).select(*keep, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role"))
    lefts = dealt.where(~one & ~F.col("visitor")).select(*keep, spot("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("role"))
    rights = dealt.where(~one | F.col("visitor")).select(*keep, every("lefts").alias("i"), spot("rights").alias("j"), F.lit(1).alias("role"))
    members = both.unionByName(lefts).unionByName(rights).join(distinct.select("uid", "copies", "embedding"), "uid")
    found = members.groupBy(*CELL, "i", "j").applyInPandas(_tile(cosine), "a long, b long, n long")
    found = materialize(found, "links")

    degree = found.groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
    linked = connected_components(found.where("b is not null"), "a", "b").select(F.col("node").alias("uid"), "component")
    whole = distinct.join(degree, "uid", "left").join(linked, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    known = whole.join(least, "component").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id"
    )
    joined = rows.where("usable").join(known, ["label", "embedding"]).select("id", "links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).alias("links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("links").cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
