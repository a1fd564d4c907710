"""Connected components by randomised contraction (Boegeholz et al., 2020).

Every round each node goes to its lowest neighbour, or stays if it is lower
itself; links are renamed to where their ends went, and those inside one node
and repeats are dropped.  Any such move keeps the components, so the links
only get fewer.  After the first round moves are followed one step further.
Nodes rank by number in the first two rounds, then by a hash drawn anew every
other round: the first round of a draw leaves at most 3/4 of the nodes in the
mean whatever their numbers, the second one folds the stars it leaves.  So
O(log n) rounds are expected, and nearly all work is in the first two.

A round is one partially aggregated minimum and two joins with it.  The
busiest nodes (never more than ``HOT_NODES``) are looked up by broadcast, so a
hub is not gathered in one task.  Every round is written to a scratch table.
The moves are then followed back from the last round to the first, which costs
one join per round with a table as long as that round has nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import materialize

HOT_NODES = 1000

#: Below this many links the busiest node fits one task anyway.
HOT_FROM = 5_000_000


def _rank(node: str, draw: int) -> Column:
    return F.xxhash64(F.lit(draw), node) if draw else F.col(node)


def _moves(links: DataFrame, draw: int) -> DataFrame:
    """u, to, degree: the lowest of every node and its neighbours."""
    both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    near = both.groupBy("u").agg(
        F.min_by("v", _rank("v", draw)).alias("v"), F.count(F.lit(1)).alias("degree")
    )
    stays = _rank("u", draw) < _rank("v", draw)
    return near.select("u", F.when(stays, F.col("u")).otherwise(F.col("v")).alias("to"), "degree")


def _ends(moves: DataFrame) -> DataFrame:
    """u, to, degree: the smallest and the number of the nodes that go to u."""
    return moves.groupBy(F.col("to").alias("u")).agg(F.min("u").alias("to"), F.count(F.lit(1)).alias("degree"))


def _busy(nodes: DataFrame, size: int) -> DataFrame | None:
    """The nodes that more than a small share of ``size`` rows may name."""
    if size < HOT_FROM:
        return None
    return materialize(nodes.where(F.col("degree") > max(size / HOT_NODES, 1000)).select("u"), "busy")


def _renamed(rows: DataFrame, column: str, moves: DataFrame, busy: DataFrame | None) -> DataFrame:
    """``rows`` with the node in ``column`` replaced by where it goes, if it is in ``moves``."""
    moves = moves.select(F.col("u").alias("_node"), F.col("to").alias("_to"))
    if busy is None:
        found = rows.join(moves, F.col(column) == F.col("_node"), "left")
        return found.withColumn(column, F.coalesce("_to", column)).select(*rows.columns)
    busy = busy.select(F.col("u").alias("_busy"))
    known = moves.join(F.broadcast(busy), F.col("_node") == F.col("_busy")).select("_node", "_to")
    hot = busy.join(F.broadcast(known), F.col("_busy") == F.col("_node"), "left")
    hot = hot.select("_busy", F.coalesce("_to", "_busy").alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(column) == F.col("_busy"), "left")
    # rows of hot nodes are spread by their content; what they may hit is not used
    key = F.when(F.col("_hot").isNull(), F.col(column)).otherwise(F.xxhash64(*rows.columns))
    found = marked.withColumn("_key", key).join(moves, F.col("_key") == F.col("_node"), "left")
    return found.withColumn(column, F.coalesce("_hot", "_to", column)).select(*rows.columns)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its smallest node) for every node that has an edge."""
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    links = materialize(pairs.where("u <> v"), "edges")
    rounds: list[DataFrame] = []
    while size := links.count():
        moves = materialize(_moves(links, len(rounds) // 2), "moves")
        busy = _busy(moves, 2 * size)
        if rounds:
            moves = materialize(_renamed(moves, "to", moves, busy), "moves")
        ends = _renamed(_renamed(links, "u", moves, busy), "v", moves, busy)
        ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = materialize(ends.where("u <> v").distinct(), "links")
        rounds.append(moves.select("u", "to"))
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = rounds.pop()
    for moves in reversed(rounds):
        found = _renamed(moves, "to", found, _busy(_ends(moves), moves.count()))
    found = materialize(found, "found")
    ends = materialize(_ends(found), "least")
    named = _renamed(found, "to", ends, _busy(ends, found.count()))
    return named.select(F.col("u").alias("node"), F.col("to").alias("component"))
