"""Source divergence audit by chunk factorization.

How much do the sources of a language differ in the words they use, and in
which?  Texts are cut at ASCII white space into chunks.  Each distinct chunk of
the whole corpus is tokenized once, and its terms are joined back to the chunk
counts, so tokenizing costs time by the vocabulary and not by the text.

    chunks     per document: its chunks and how often it has each; summed per
               language and source inside the task, then dealt into buckets by chunk
    tokenize   lower-cased runs of ASCII letters and of all other characters
               above ASCII, once per distinct chunk of a bucket
    join back  its terms take the rows' counts along, dealt into buckets by term

Those are the only two shuffles.  What a task has for one bucket travels as one
row of arrays, items side by side (they hold no white space), and a bucket is
summed in whole arrays; there are ``BUCKETS_PER_PART`` buckets per partition of
the input, so a bucket does not grow with the table.

A term is kept if at least ``min_docs`` documents of the language hold it.  Two
chunks of one document may hold the same term, so documents are told apart by a
number of their row: a task sends the first ``min_docs`` - 1 row numbers of a
chunk, or none once it has seen it in ``min_docs`` documents, and the union over
a term's chunks decides exactly.  A chunk that all documents share thus costs
one narrow row per task and source.

With c occurrences of a term in a group, N of all kept terms there and V kept
terms in the language, p = 1 + floor(10^9 (c + 1) / (N + V)), and two
distributions differ at a term by f = floor((p - q)^2 / q).  The sum of f over
all V terms for a pair of sources needs only terms that one of them uses: with
zero counts as the base,

    sum f(a, b) = V f(0, 0) + sum over a's terms of f(a, 0) - f(0, 0)
                + sum over b's terms of f(0, b) - f(0, 0)
                + sum over common terms of f(a, b) - f(a, 0) - f(0, b) + f(0, 0)

and terms with equal counts of a source are taken together.  All sums are whole
numbers.

Defined cases: null text, language and source count as empty.  A row is a
document, whatever its id.  Groups without terms are kept; a language without
kept terms has values of 0.  A language with one source has no pairs.  Values
are whole numbers of up to 38 digits inside and longs in the result.  Ties rank
by item in UTF-8 order.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import broadcast_if_small
from topicloom.runtime import materialize

#: In UTF-8, characters above ASCII are the bytes from 0x80 on.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS = 3
TOP_TERMS = 200
PARTS = 1_000_000_000

#: Bytes of text cut at once, or one text if it is longer, and chunks counted at once.
BYTES_AT_ONCE = 1 << 22
CHUNKS_AT_ONCE = 1 << 20
BUCKETS_PER_PART = 4
#: Packed rows in one batch.
ROWS_AT_ONCE = 64
#: Assumed size of one (language, source) row in a broadcast.
GROUP_BYTES = 160

GROUP = ["lang", "source"]
PACKED = (
    "bucket int, langs array<string>, sources array<string>, items binary, "
    "groups array<int>, counts array<long>, known array<int>, rows array<long>"
)


@dataclass
class Entries:
    """Counted items side by side: each one's group, count and documents.

    ``known`` says how many row numbers of its documents an entry has in
    ``rows``; none means that it has enough of them.
    """

    groups: list[tuple[str, str]]
    items: list[bytes]
    group: np.ndarray
    count: np.ndarray
    known: np.ndarray
    rows: np.ndarray

    def packed(self, buckets: int) -> Iterator[tuple]:
        """One row of arrays for each bucket, groups together in it."""
        if not self.items:
            return
        place = np.fromiter((zlib.crc32(i) % buckets for i in self.items), np.int64, len(self.items))
        order = np.lexsort((self.group, place))
        ends = np.append(np.flatnonzero(np.diff(place[order])) + 1, len(order))
        first = np.cumsum(self.known) - self.known
        langs, sources = map(list, zip(*self.groups))
        for start, end in zip(np.append(0, ends[:-1]), ends):
            own = order[start:end]
            many = self.known[own]
            at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            items = b" ".join([self.items[i] for i in own.tolist()])
            yield int(place[own[0]]), langs, sources, items, self.group[own], self.count[own], many, self.rows[at]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Packed rows as record batches."""
    text, whole, long = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())
    types = [pa.int32(), text, text, pa.binary(), whole, long, whole, long]
    names = [n.split()[0] for n in PACKED.split(", ")]
    while held := list(islice(rows, ROWS_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*held)), types)], names)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Entries]:
    """The entries of one bucket after the other, from rows sorted by bucket."""
    last, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            bucket = row.column(0)[0].as_py()
            if held and bucket != last:
                yield _together(held)
                held = []
            last = bucket
            held.append(row)
    if held:
        yield _together(held)


def _together(rows: list[pa.RecordBatch]) -> Entries:
    numbers: dict[tuple[str, str], int] = {}
    items, parts = [], []
    for row in rows:
        named = zip(row.column(1)[0].as_py(), row.column(2)[0].as_py())
        number = np.array([numbers.setdefault(g, len(numbers)) for g in named])
        items += row.column(3)[0].as_py().split(b" ")
        group, count, known, documents = (row.column(k).flatten().to_numpy() for k in range(4, 8))
        parts.append((number[group], count, known, documents))
    return Entries(list(numbers), items, *(np.concatenate(p) for p in zip(*parts)))


def _numbered(items: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    coded = pa.array(items, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _documents(key: np.ndarray, n: int, known: np.ndarray, rows: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per key: whether ``min_docs`` documents are known; and (key, row) of the documents of the others."""
    enough = np.zeros(n, dtype=bool)
    enough[key[known == 0]] = True
    owner = np.repeat(key, known)
    open_ = ~enough[owner]
    order = np.lexsort((rows[open_], owner[open_]))
    owner, rows = owner[open_][order], rows[open_][order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (rows[1:] != rows[:-1]))[: len(owner)]
    owner, rows = owner[new], rows[new]
    enough |= np.bincount(owner, minlength=n) >= min_docs
    few = ~enough[owner]
    return enough, owner[few], rows[few]


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each entry's position among them, and the sums."""
    keys, at = np.unique(key, return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, at, count)
    return keys, at, sums


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Some rows, their chunks one after the other, and the row (by position) of each."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, side="right")))
            part = batch.slice(at, end - at)
            # a view, as nothing but ASCII white space is looked for
            lists = pc.ascii_split_whitespace(part.column("text").view(pa.string()))
            row = np.repeat(np.arange(end - at), pc.list_value_length(lists).to_numpy())
            chunks = lists.flatten()
            some = pc.greater(pc.binary_length(chunks), 0)
            chunks, row = chunks.filter(some), row[some.to_numpy(zero_copy_only=False)]
            del lists, some
            yield part, chunks, row
            at = end


def _counted(groups: list[tuple[str, str]], group: np.ndarray, row: np.ndarray, chunks: pa.Array, min_docs: int) -> Entries:
    """Chunks counted per document, then summed per group; ``row`` rises along the chunks."""
    coded = chunks.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(groups) + group
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
    per_document = np.diff(np.append(first, len(key)))
    key, row = key[first], row[first]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    documents = np.diff(np.append(start, len(key)))
    few = documents < min_docs
    items = coded.dictionary.take(pa.array(key[start] // len(groups))).view(pa.binary()).to_pylist()
    return Entries(groups, items, key[start] % len(groups), np.add.reduceat(per_document, start), np.where(few, documents, 0), row[np.repeat(few, documents)])


def _count_chunks(min_docs: int, buckets: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, chunks, at in _tokens(batches):
            named = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
            groups = list(dict.fromkeys(named))
            number = {g: i for i, g in enumerate(groups)}
            group, row = np.array([number[g] for g in named]), part.column("row").to_numpy()
            for first in range(0, len(chunks), CHUNKS_AT_ONCE):  # a long text may be cut: its row number tells
                own = slice(first, first + CHUNKS_AT_ONCE)
                place = at[own]
                yield from _counted(groups, group[place], row[place], chunks[own], min_docs).packed(buckets)

    return lambda batches: _batches(rows(batches))


def chunk_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, buckets: int = 1,
) -> DataFrame:
    """The chunks of every (language, source) with their counts and documents, packed by bucket."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(
        plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    return texts.mapInArrow(_count_chunks(min_docs, buckets), PACKED)


def _tokenize(min_docs: int, buckets: int) -> Callable:
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _buckets(batches):
            code, chunks = _numbered(part.items)
            wide = len(part.groups)
            keys, at, counts = _summed(code * wide + part.group, part.count)
            _, owner, rows = _documents(at, len(keys), part.known, part.rows, min_docs)
            known = np.bincount(owner, minlength=len(keys))
            first = np.cumsum(known) - known
            starts = np.searchsorted(keys // wide, np.arange(len(chunks) + 1))  # a chunk's groups are side by side
            chunk, term, times = [], [], []
            for c, text in enumerate(chunks):
                found = TERM.findall(text.lower())
                if len(found) == 1:  # most chunks by far
                    chunk.append(c), term.append(found[0]), times.append(1)
                    continue
                for t, n in Counter(found).items():
                    chunk.append(c), term.append(t), times.append(n)
            if not chunk:
                continue
            chunk, times = np.array(chunk), np.array(times)
            many = starts[chunk + 1] - starts[chunk]
            entry = np.repeat(starts[chunk] - np.cumsum(many) + many, many) + np.arange(many.sum())
            taken = known[entry]
            documents = rows[np.repeat(first[entry] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())]
            items = [t for t, m in zip(term, many.tolist()) for _ in range(m)]
            yield from Entries(part.groups, items, keys[entry] % wide, counts[entry] * np.repeat(times, many), taken, documents).packed(buckets)

    return lambda batches: _batches(terms(batches))


def tokenize_chunks(counted: DataFrame, min_docs: int = MIN_DOCS, buckets: int = 1) -> DataFrame:
    """The terms of all chunks with the chunks' counts and documents, packed by bucket; each distinct chunk is tokenized once."""
    together = counted.repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(_tokenize(min_docs, buckets), PACKED)


def _keep(min_docs: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _buckets(batches):
            code, terms = _numbered(part.items)
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(g[0] for g in part.groups))}
            spoken = np.array([langs[g[0]] for g in part.groups])
            held, at = np.unique(code * len(langs) + spoken[part.group], return_inverse=True)
            enough, _, _ = _documents(at, len(held), part.known, part.rows, min_docs)
            kept = enough[at]
            keys, _, counts = _summed((code * len(part.groups) + part.group)[kept], part.count[kept])
            group, term = (keys % len(part.groups)).tolist(), (keys // len(part.groups)).tolist()
            columns = [pa.array([part.groups[g][k] for g in group], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([terms[t] for t in term], pa.binary()), pa.array(counts)], ["lang", "source", "term", "n"])

    return keep


def term_counts(counted: DataFrame, min_docs: int = MIN_DOCS, buckets: int = 1) -> DataFrame:
    """lang, source, term, count of the terms that enough documents of the language hold."""
    terms = tokenize_chunks(counted, min_docs, buckets).repartition("bucket").sortWithinPartitions("bucket")
    kept = terms.mapInArrow(_keep(min_docs), "lang string, source string, term binary, n long")
    return kept.select(*GROUP, F.col("term").cast("string").alias("term"), F.col("n").alias("count"))


def _share(count: str, total: str, wide: bool) -> str:
    """SQL of p (any, if no term is kept), exact in decimals where 10^9 (count + 1) may be too ``wide`` for a long."""
    if wide:
        return f"1 + ({PARTS} * (cast({count} as decimal(28,0)) + 1)) div cast(greatest({total}, 1) as decimal(38,0))"
    return f"1 + ({PARTS} * ({count} + 1)) div greatest({total}, 1)"


def _difference(p: str, q: str) -> str:
    """SQL of f; its factors are at most about 10^9."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _too_wide(groups: DataFrame) -> bool:
    """Whether 10^9 times a language's total leaves the range of longs."""
    most = groups.agg(F.max("lang_total")).first()[0] or 0
    return PARTS * (most + 1) >= 1 << 63


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language.

    ``counts`` is a written ``term_counts``; ``groups`` (written) has lang,
    source, kept (V), total (N + V) and lang_total, one row per group.
    """
    wide = _too_wide(groups)
    known = broadcast_if_small(groups.select(*GROUP, "total", "kept"), GROUP_BYTES)
    a = counts.join(known, GROUP).selectExpr("lang", "term", "source AS a", f"{_share('count', 'total', wide)} AS pa", f"{_share('0', 'total', wide)} AS za")
    b = a.select("lang", "term", *[F.col(c).alias(c.replace("a", "b")) for c in ("a", "pa", "za")])
    both = " - ".join([_difference("pa", "pb"), f"({_difference('pa', 'zb')})", f"({_difference('za', 'pb')})"]) + f" + {_difference('za', 'zb')}"
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    shared = a.join(b, ["lang", "term"]).where("a <> b").selectExpr("lang", "a", "b", f"{both} AS value")
    shared = shared.groupBy("lang", "a", "b").agg(exact("value"))

    sized = groups.selectExpr("lang", "source", "kept", f"{_share('0', 'total', wide)} AS zero")
    pairs = sized.selectExpr("lang", "source AS a", "kept", "zero AS za").join(sized.selectExpr("lang", "source AS b", "zero AS zb"), "lang").where("a <> b")
    alike = materialize(counts.groupBy(*GROUP, "count").agg(F.count(F.lit(1)).alias("n")).join(known, GROUP), "alike")
    alike = alike.selectExpr("lang", "source", "n", f"{_share('count', 'total', wide)} AS p")
    times = lambda f: F.sum(F.expr(f).cast("decimal(38,0)") * F.col("n")).alias("value")
    of_a = alike.withColumnRenamed("source", "a").join(pairs, ["lang", "a"])
    of_a = of_a.groupBy("lang", "a", "b").agg(times(f"{_difference('p', 'zb')} - {_difference('za', 'zb')}"))
    of_b = alike.withColumnRenamed("source", "b").join(pairs, ["lang", "b"])
    of_b = of_b.groupBy("lang", "a", "b").agg(times(f"{_difference('za', 'p')} - {_difference('za', 'zb')}"))
    base = pairs.select("lang", "a", "b", (F.expr(_difference("za", "zb")).cast("decimal(38,0)") * F.col("kept")).alias("value"))
    parts = [p.select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value")) for p in (shared, of_a, of_b, base)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "a", "b").agg(exact("value"))
    return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("value").cast("long").alias("value"))


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    buckets = BUCKETS_PER_PART * docs.rdd.getNumPartitions()
    counts = materialize(term_counts(chunk_counts(docs, text_col, lang_col, source_col, min_docs, buckets), min_docs, buckets), "counts")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    in_lang = materialize(counts.groupBy("lang", "term").agg(F.sum("count").alias("count")), "lang-counts")
    langs = in_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("count").alias("whole"))
    used = counts.groupBy(*GROUP).agg(F.sum("count").alias("used"))
    groups = every.join(used, GROUP, "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    groups = groups.select(*GROUP, zero("kept").alias("kept"), (zero("used") + zero("kept")).alias("total"), (zero("whole") + zero("kept")).alias("lang_total"))
    groups = materialize(groups, "groups")

    first = lambda cols: Window.partitionBy(*cols).orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(counts, groups).withColumn("part", F.lit("pair"))
    sized = counts.join(in_lang.withColumnRenamed("count", "lang_count"), ["lang", "term"]).join(broadcast_if_small(groups, GROUP_BYTES), GROUP)
    wide = _too_wide(groups)
    shares = sized.selectExpr("lang", "source", "term AS item", f"{_share('count', 'total', wide)} AS p", f"{_share('lang_count', 'lang_total', wide)} AS q")
    terms = shares.where("p > q").selectExpr("lang", "source", "item", f"{_difference('p', 'q')} AS value").withColumn("part", F.lit("term"))
    rank = F.row_number().over(first(GROUP))
    out = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top_terms))
    return out.select(*GROUP, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
