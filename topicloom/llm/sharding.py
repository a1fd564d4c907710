"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard.  On each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the seed, the child and the row's
key, and the least draw wins, so children get rows in proportion to their
weights.  A child's draw depends on its own weight alone: where a subtree's
weight changes, rows move only into it or out of it, all others stay.

``grow`` adds a shard as a region of its own.  No other weight changes, so rows
move only into the new shard: the ``key`` law, by which key and tree decide.

Slots number a shard's rows from 0 without gaps: each shard is cut into parts
by a hash of the columns and the text's checksum, parts are counted (partial
sums), rows are numbered in their part and moved up by the counts before it.  No
task holds a whole shard; rows meet in a part without limit only if all of that
is equal.

Defined cases: a null key is a key of its own.  Null text has no bytes and the
checksum of the empty string.  Repeated rows share the shard and get slots of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import hash_inputs, null_key, pack

#: Shards by rack, racks by region; a shard is (number, weight).
Tree = list[list[list[tuple[int, float]]]]

#: Rows of one part, over all shards.
PART_ROWS = 100_000
ROW_OVERHEAD = 16
SEED = 20_240


def balanced_tree(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """``shards`` of weight 1, as even as they go over regions and racks."""
    cut = lambda items, n: [items[len(items) * i // n : len(items) * (i + 1) // n] for i in range(n)]
    return [[[(s, 1.0) for s in rack] for rack in cut(region, racks) if rack] for region in cut(list(range(shards)), regions) if region]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered next, in a region of its own."""
    last = max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(last + 1, weight)]]]


def _least(children: Column, level: int, key: Column, seed: int) -> Column:
    """Number of the child with the least draw."""

    def draw(child: Column) -> Column:
        hashed = F.xxhash64(F.lit(seed).cast("long"), F.lit(level).cast("long"), child["node"], key)
        unit = (F.shiftrightunsigned(hashed, 11) + 1) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(children, draw))["node"]


def _children(nodes: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).cast("long").alias("node"), F.lit(float(w)).alias("weight")) for n, w in nodes if w > 0])


def place(df: DataFrame, tree: Tree, key: str, name: str, seed: int = SEED) -> DataFrame:
    """``df`` with the shard of each row under ``tree`` as the int column ``name``.

    ``key`` is a column that is never null.  Racks are numbered through all
    regions, so that adding a region at the end renumbers nothing.
    """
    racks = [rack for region in tree for rack in region]
    weight = lambda rack: sum(w for _, w in rack)
    regions, at = [], 0
    for region in tree:
        regions.append([(at + i, weight(rack)) for i, rack in enumerate(region)])
        at += len(region)
    top = _children([(i, sum(w for _, w in region)) for i, region in enumerate(regions)])
    pick = lambda lists, n: F.element_at(F.array(*map(_children, lists)), F.col(n).cast("int") + 1)
    levels = [f"{name}_region", f"{name}_rack"]
    out = df.withColumn(levels[0], _least(top, 0, F.col(key), seed))
    out = out.withColumn(levels[1], _least(pick(regions, levels[0]), 1, F.col(key), seed))
    return out.withColumn(name, _least(pick(racks, levels[1]), 2, F.col(key), seed).cast("int")).drop(*levels)


def shard(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", grown: Tree | None = None) -> DataFrame:
    """``row`` (the whole input row), size, text_crc32, shard, slot and grown_shard.

    grown_shard is the shard under ``grown``, null without it.
    """
    beside = hash_inputs(docs.schema, text_col)
    parts = 1 + docs.select(id_col).count() // PART_ROWS
    sized = pack(
        docs,
        key=null_key(id_col),
        size=F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_OVERHEAD,
        text_crc32=F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")),
    )
    keyed = sized.withColumn("order", F.xxhash64("text_crc32", *beside)).withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts)).cast("int"))
    placed = place(keyed, tree, "key", "shard")
    if grown:
        placed = place(placed, grown, "key", "grown_shard")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("order")
    numbered = placed.withColumn("at", F.row_number().over(own)).join(first, ["shard", "part"])
    return numbered.select("row", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"), "grown_shard")
