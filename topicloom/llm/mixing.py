"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all
words.  A target stops at three times its source's size; what is above is
shared again by weight.  With capped sources sorted by cap over weight, the
level that shares everything is the largest of (total - caps before) / (weights
not before), one window over the source totals.

A source takes each document as often as its target covers it whole.  The rest
is a budget below its size: documents are counted by exact length, each length
gives its even share, single documents bring the remainder near ``REST`` words,
and a bounded knapsack (subset sums with counts, split in powers of two) hits
it as closely as it can.  Which documents of a length are taken is a seeded
draw: ranks by a hash inside buckets of about ``BUCKET`` rows, so that copies
of one document never meet in one task.

One task holds the lengths of one source, a table that grows with the longest
text and not with the rows.  Targets and quotas are the same on every run.

Defined cases: null text has size 0.  Null sources are one source, empty ones
another.  Rows with null or repeated ids are drawn as any other; equal rows
stand for each other.  Sources without words have target 0 and take nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import WORD, broadcast_if_small, hash_inputs, null_key, pack
from topicloom.runtime import materialize

MAX_REPEATS = 3
#: Words left to the knapsack, at least; it also takes what longer documents leave.
REST = 1 << 15
#: Rows of one length and source that are ranked together.
BUCKET = 512
SEED = 4_219


def word_count(text_col: str) -> Column:
    """Words of a text, null as 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame) -> DataFrame:
    """key, source_size and target; ``totals`` has key and source_size, one row per source."""
    everything = Window.partitionBy(F.lit(0))
    weighed = totals.withColumn("weight", 1 + (F.row_number().over(everything.orderBy("key")) - 1) % 3)
    weighed = weighed.withColumn("cap", F.lit(MAX_REPEATS) * F.col("source_size"))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    level = (F.sum("source_size").over(everything) - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    levels = weighed.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return levels.select("key", "source_size", target.alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is the largest one within ``budget``."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return taken
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        most = min(count, budget // length) if length else 0
        many = 1
        while most > 0 and not reached[budget]:
            many = min(many, most)
            weight = many * length
            fresh = reached[: budget + 1 - weight] & ~reached[weight:]
            by[weight:][fresh] = len(items)
            reached[weight:] |= fresh
            items.append((i, many))
            most -= many
            many *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:  # an item that first reached a sum builds on sums reached before it
        i, many = items[by[at]]
        taken[i] += many
        at -= many * int(lengths[i])
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """Documents to take of each length for a budget of words up to the sum of all."""
    size = int((lengths * counts).sum())
    if budget >= size:
        return counts.copy()
    taken = (counts * (budget / size)).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    part = counts * (budget / size) - taken
    order = np.lexsort((np.random.default_rng(seed).permutation(len(lengths)), -part))
    for i in order:
        if left <= REST:
            break
        if taken[i] < counts[i] and lengths[i] <= left:
            taken[i] += 1
            left -= int(lengths[i])
    shuffled = np.random.default_rng(seed + 1).permutation(len(lengths))
    more = knapsack(lengths[shuffled], (counts - taken)[shuffled], left)
    taken[shuffled] += more
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size").reset_index(drop=True)
    size, target = int(group["source_size"][0]), float(group["target"][0])
    whole = min(int(target // size), MAX_REPEATS) if size else 0
    rest = min(round(target - whole * size), size) if whole < MAX_REPEATS else 0
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    extra = fit_budget(lengths, counts, rest) if rest > 0 else np.zeros(len(group), dtype=np.int64)
    return group.assign(whole=whole, extra=np.where(lengths > 0, extra, 0))


def mix(rows: DataFrame) -> DataFrame:
    """``row``, size, source_size, target and copies (how often the mix takes the row).

    ``rows`` has row (a struct), key (never null), size and draw (a seeded hash).
    """
    lengths = materialize(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    planned = lengths.join(source_targets(totals), "key").groupBy("key")
    schema = "key string, size long, n long, source_size long, target double, whole long, extra long"
    plan = materialize(planned.applyInPandas(_plan, schema), "plan")
    buckets = F.ceil(F.col("n") / BUCKET)
    tagged = rows.join(broadcast_if_small(plan, 96), ["key", "size"])
    tagged = tagged.withColumn("bucket", F.pmod("draw", buckets))
    group = ["key", "size", "bucket"]
    counts = tagged.where(buckets > 1).groupBy(*group).agg(F.count(F.lit(1)).alias("here"), F.first("extra").alias("all"))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("here").over(before), F.lit(0))
    quota = materialize(counts.select(*group, F.greatest(left, F.lit(0)).alias("quota")), "quotas")
    # Dealt by bucket whatever the joins did: a source's length may hold a third of all rows.
    ranked = tagged.join(broadcast_if_small(quota, 64), group, "left").repartition(*group)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("draw", F.xxhash64(*hash_inputs(rows.schema["row"].dataType))))
    more = (rank <= F.coalesce("quota", "extra")).cast("long")
    return ranked.select("row", "size", "source_size", "target", (F.col("whole") + more).alias("copies"))


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """Source, size and draw of a row; the text parts rows without an id of their own."""
    return {"key": null_key(source_col), "size": word_count(text_col), "draw": F.xxhash64(F.lit(SEED), null_key(id_col), text_col)}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target (of its source) and taken (size times copies) of every row."""
    keys = _keys(id_col, text_col, source_col)
    sized = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), *[c.alias(n) for n, c in keys.items()])
    mixed = mix(materialize(sized, "sized"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select(F.col("row.id").alias(id_col), "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each as often as it is taken."""
    rows = pack(docs, **_keys(id_col, text_col, source_col))
    mixed = mix(rows).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
