"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints within 3 bits differ in at most one bit in one of their
two 32-bit segments.  Each segment is indexed under its 32 one-wildcard
variants (the position, and the segment with that bit cleared), so such a pair
meets in an equality on one variant and is verified there on all 64 bits.

Only distinct fingerprints are indexed: exact copies never meet each other.  A
variant group matters only if it holds both values of the wildcard bit, or, at
position 0, two fingerprints at all; the rest is dropped by a window right
after the one shuffle of the index.  Larger groups are dealt out in pairs of
blocks of bounded size.  A group returns a spanning forest of its close pairs,
never all pairs.

Defined cases: null or empty text has no words and fingerprint 0, linked like
any other.  Rows with null ids take part; a group's id is its smallest non-null
id, null if it has none.  Repeated rows are copies of each other.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from topicloom.llm.common import null_key, pack
from topicloom.operators.components import connected_components
from topicloom.runtime import materialize

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
SEGMENT_BITS = 32

#: Fingerprints compared with each other in one block of a variant group.
BLOCK = 512

#: Shingle hashes counted at once; bounds the memory of one long text.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    words = text.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[SHINGLE_WORDS - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, HASHES_AT_ONCE):
        part = zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) if t else 0 for t in texts], dtype="int64")


def fingerprint_of(text_col: str) -> Column:
    """Fingerprint column of a text column."""
    return simhash(F.col(text_col).cast("binary"))


def _forest(values: np.ndarray, left: int, position: int, segment: int) -> list[tuple[int, int]]:
    """Edges that connect what close pairs connect, among one block pair of one variant group.

    The first ``left`` values are compared with each other if no others follow,
    else with those others.  A pair counts in a group only if its segments
    differ in just the group's bit, or at position 0 also if they are equal.
    """
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    shift = np.uint64(SEGMENT_BITS * segment)
    mask = np.uint64((1 << SEGMENT_BITS) - 1)
    for i in range(left):
        after = i + 1 if left == len(values) else left
        apart = values[i] ^ values[after:]
        close = np.bitwise_count(apart) <= RADIUS
        here = (apart >> shift) & mask
        close &= here == (1 << position) if position else here <= 1
        for j in np.flatnonzero(close).tolist():
            a, b = root(i), root(after + j)
            if a != b:
                parent[b] = a
                edges.append((i, after + j))
    return edges


def _group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [], []
        columns = (batch.column(c).to_pylist() for c in ("variant", "first", "second", "members"))
        for variant, first, second, members in zip(*columns):
            segment, position = divmod(variant >> SEGMENT_BITS, SEGMENT_BITS)
            a = np.array([m["fp"] for m in members if m["block"] == first], dtype=np.int64)
            b = np.array([m["fp"] for m in members if m["block"] != first], dtype=np.int64)
            both = np.concatenate([a, b])
            for i, j in _forest(both.view(np.uint64), len(a), position, segment):
                src.append(both[i])
                dst.append(both[j])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def close_edges(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, dst: edges whose components are those of all pairs within ``RADIUS`` bits.

    ``prints`` has one column ``fp`` of distinct fingerprints.
    """
    fp = F.col("fp")
    low = F.lit((1 << SEGMENT_BITS) - 1)
    variants = []
    for segment in range(64 // SEGMENT_BITS):
        value = F.shiftrightunsigned(fp, SEGMENT_BITS * segment).bitwiseAND(low)
        for position in range(SEGMENT_BITS):
            code = (segment * SEGMENT_BITS + position) << SEGMENT_BITS
            variants.append(value.bitwiseAND(F.lit(~(1 << position))).bitwiseOR(F.lit(code)))
    index = prints.select("fp", F.explode(F.array(*variants)).alias("variant"))
    place = F.shiftright("variant", SEGMENT_BITS).cast("int")
    bit = F.expr("shiftrightunsigned(fp, cast(shiftright(variant, 32) as int)) & 1")
    group = Window.partitionBy("variant")
    met = (
        index.withColumn("bit", bit)
        .select("fp", "variant", F.count(F.lit(1)).over(group).alias("n"), (F.max("bit").over(group) > F.min("bit").over(group)).alias("both"))
        .where(F.col("both") | ((place % SEGMENT_BITS == 0) & (F.col("n") > 1)))
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = met.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    dealt = own.select(
        "variant", "fp", "block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("other")
    )
    pairs = dealt.groupBy(
        "variant", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    ).agg(F.collect_list(F.struct("fp", "block")).alias("members"))
    return pairs.where(F.size("members") > 1).mapInArrow(_group_edges, "src long, dst long")


def near_groups(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``fp``, ``component`` (a fingerprint) and ``component_id`` (the smallest id in it).

    ``rows`` must be a written table: it is read for the fingerprints and again by the caller.
    """
    prints = rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    prints = materialize(prints, "prints")
    linked = connected_components(materialize(close_edges(prints.select("fp")), "close"))
    grouped = prints.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return grouped.join(smallest, "component").select("fp", "component", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialize(docs.select(F.col(id_col), fingerprint_of(text_col).alias("_fp")), "fingerprints")
    groups = near_groups(rows, id_col, "_fp")
    return rows.join(groups, rows["_fp"] == groups["fp"]).select(
        F.col(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id, any one of rows with equal id and text.

    Whole rows are shuffled once, to meet the kept keys; those grow with the
    table and are not broadcast at any size.
    """
    text_hash = F.xxhash64(text_col)
    keys = docs.select(F.col(id_col).alias("id"), fingerprint_of(text_col).alias("fp"), text_hash.alias("hash"))
    keys = materialize(keys, "fingerprinted")
    groups = near_groups(keys, "id", "fp")
    best = F.min(F.struct(F.isnull("id").alias("none"), "id", "hash")).alias("best")
    kept = keys.groupBy("fp").agg(best).join(groups, "fp").groupBy("component").agg(F.min("best").alias("best"))
    kept = materialize(kept.select("best.id", "best.hash"), "kept").select(null_key("id").alias("key"), "hash")
    rows = pack(docs, key=null_key(id_col), hash=text_hash).join(kept.hint("merge"), ["key", "hash"], "left_semi")
    first = F.row_number().over(Window.partitionBy("key", "hash").orderBy("hash"))
    return rows.withColumn("at", first).where("at = 1").select("row.*")
