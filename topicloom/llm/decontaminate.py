"""Benchmark decontamination by SimHash windows of the items' own sizes.

For each item length (in words) a document's windows of that many words are
fingerprinted: 64-bit SimHash of five-word shingles, from one running sum of
hash bits; a text of fewer words than the item is one window.  Fingerprints are cut into eight 8-bit blocks.  Two within
``RADIUS`` = 23 bits differ in at most two bits in one block, so a table of all
block values within two bits of an item's finds every such pair.  Candidates
within the radius are then verified exactly: weighted Jaccard similarity of the
shingles, each weighing as often as it occurs, must reach ``SIMILARITY``.

A window can only reach that similarity if at least t/(1+t) of its and the
item's shingles together occur in some item.  Windows below that number are not
fingerprinted; this drops no match.  Texts are read whole and never shuffled; the items' tables go to
every worker.  Items of equal text are searched once.  A benchmark of more than
``ITEMS_AT_ONCE`` texts or ``CHARS_AT_ONCE`` characters is searched in several
passes.

Words are runs of word characters in lower case.  An item of fewer than five
words is one shingle.  Null and empty items match nothing, and null or empty
texts have no windows.  Items with the same id, or none, are reported each;
documents with null or repeated ids too, row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import broadcast_if_small, pack
from topicloom.runtime import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEMS_AT_ONCE = 20_000
CHARS_AT_ONCE = 16_000_000

MATCHES = "array<struct<item:long,start_word:int,n_words:int,similarity:double>>"
FIND_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return FIND_WORDS.findall(text.lower())


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)


def _prints(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from counts of set bits among ``n`` hashes."""
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return 0


class Index:
    """The items of one pass: their shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary = _Vocabulary()
        self.numbers, self.shingles, prints = [], [], []
        self.by_length: dict[int, list[int]] = defaultdict(list)
        codes: dict[int, set[int]] = defaultdict(set)
        for number, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            width = min(SHINGLE_WORDS, len(words))
            codes[width].update(self.coded(ids, width).tolist())
            hashes = [_hash(words[i : i + width]) for i in range(len(words) - width + 1)]
            prints.append(_prints(_bits(np.array(hashes, np.uint64)).sum(axis=0, dtype=np.int64)[None], len(hashes))[0])
            self.by_length[len(words)].append(len(self.numbers))
            self.numbers.append(number)
            self.shingles.append(Counter(hashes))
        self.prints = np.array(prints, dtype=np.uint64)
        self.codes = {w: np.array(sorted(c), dtype=np.uint64) for w, c in codes.items()}
        self.members = {n: np.array(m) for n, m in self.by_length.items()}
        self.tables = self.block_tables()

    @staticmethod
    def coded(ids: np.ndarray, width: int) -> np.ndarray:
        """One number for the words at each place; equal words give equal numbers."""
        n = len(ids) - width + 1
        code = ids[:n].copy()
        for i in range(1, width):
            code = (code * _MIX) ^ ids[i : n + i]
        return code

    def block_tables(self) -> np.ndarray:
        """Bit sets of the items near each value of each block: [block, value, 64 items each]."""
        sets = np.zeros((BLOCKS, 1 << BLOCK_BITS, (len(self.numbers) + 63) // 64), dtype=np.uint64)
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
        for i, fp in enumerate(self.prints):
            for b in range(BLOCKS):
                own = (fp >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
                near = np.bitwise_count(values ^ own) <= BLOCK_RADIUS
                sets[b, near, i // 64] |= np.uint64(1 << (i % 64))
        return sets

    def candidates(self, prints: np.ndarray, length: int) -> list[tuple[int, int]]:
        """(window, item) pairs within ``RADIUS``, among items of ``length`` words."""
        found = np.zeros((len(prints), self.tables.shape[2]), dtype=np.uint64)
        for b in range(BLOCKS):
            found |= self.tables[b, ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)]
        out = []
        for i in self.members[length]:
            hit = np.flatnonzero((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
            close = np.bitwise_count(prints[hit] ^ self.prints[i]) <= RADIUS
            out += [(w, int(i)) for w in hit[close].tolist()]
        return out

    def matches(self, text: str) -> list[dict]:
        """The most similar window for each item that ``text`` holds."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.uint64, count=len(words))
        known, best = {}, {}
        for width, codes in self.codes.items():
            n = len(words) - width + 1
            if n < 1:
                continue
            full = np.flatnonzero(np.convolve(ids != 0, np.ones(width, dtype=np.int64), "valid") == width)
            code = self.coded(ids, width)[full]
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            full = full[codes[at] == code]
            if len(full):
                flags = np.zeros(n + 1, dtype=np.int64)
                flags[full + 1] = 1
                known[width] = np.cumsum(flags)
        for length in self.by_length:
            width = min(SHINGLE_WORDS, length)
            if width not in known:
                continue
            sums = known[width]
            whole = length - width + 1
            size = min(whole, len(sums) - 1)
            least = math.ceil(SIMILARITY * (size + whole) / (1 + SIMILARITY) - 1e-9)
            if least > size:
                continue
            starts = np.flatnonzero(sums[size:] - sums[: len(sums) - size] >= least)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                if len(part):
                    self._search(words, part, length, width, size, best)
        return [best[i] for i in sorted(best)]

    def _search(self, words: list[str], starts: np.ndarray, length: int, width: int, size: int, best: dict) -> None:
        """Fingerprint, look up and verify windows that lie close together."""
        first, last = int(starts[0]), int(starts[-1]) + size
        hashes = np.array([_hash(words[i : i + width]) for i in range(first, last)], dtype=np.uint64)
        sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
        np.cumsum(_bits(hashes), axis=0, out=sums[1:], dtype=np.int32)
        begin = starts - first
        for w, i in self.candidates(_prints(sums[begin + size] - sums[begin], size), length):
            a = int(begin[w])
            common = (Counter(hashes[a : a + size].tolist()) & self.shingles[i]).total()
            similarity = common / (size + length - width + 1 - common)
            if similarity >= SIMILARITY and similarity > best.get(i, {"similarity": 0})["similarity"]:
                best[i] = {"item": self.numbers[i], "start_word": first + a, "n_words": size + width - 1, "similarity": similarity}


_indexes: dict[str, Index] = {}


def match_column(text_col: str, items: list[tuple[int, str]], spark) -> Column:
    """Matches of each row's text among ``items`` (number, text), a list of bounded size."""
    name = xxhash.xxh64_hexdigest(repr(items))
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(shared.value)
        index = _indexes[name]
        return pd.Series([index.matches(t) if t else [] for t in texts])

    return find(F.col(text_col))


def numbered_items(benchmark: DataFrame, item_text: str = "text") -> DataFrame:
    """number and text of each distinct text of the benchmark, as a written table."""
    texts = benchmark.select(F.col(item_text).alias("text")).where("text <> ''").distinct()
    return materialize(texts.withColumn("number", F.monotonically_increasing_id()), "items")


def item_passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts in slices that fit the limits of one pass."""
    row = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    load = max(row["n"] / ITEMS_AT_ONCE, (row["chars"] or 0) / CHARS_AT_ONCE)
    slices = 1 if load <= 1 else math.ceil(load * 1.5)
    for i in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == i)
        yield [(r["number"], r["text"]) for r in part.orderBy("text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, start_word, n_words and similarity: the best window for each item in each row."""
    items = numbered_items(benchmark, item_text)
    passes = (docs.select(F.col(id_col).alias("_doc"), F.explode(match_column(text_col, part, docs.sparkSession)).alias("m")) for part in item_passes(items))
    found = reduce(DataFrame.unionByName, passes)
    named = benchmark.select(F.col(item_text).alias("text"), F.col(item_id).alias("_item")).join(items, "text")
    named = materialize(named.select("number", "_item"), "item-ids")
    hits = found.join(broadcast_if_small(named, 128), found["m.item"] == named["number"])
    return hits.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id), "m.start_word", "m.n_words", "m.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item."""
    for part in item_passes(numbered_items(benchmark, item_text)):
        docs = pack(docs, found=match_column(text_col, part, docs.sparkSession)).where(F.size("found") == 0).select("row.*")
    return docs
