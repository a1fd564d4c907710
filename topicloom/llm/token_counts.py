"""Token counts by byte-pair merging with a heap and a linked list.

A text's count is the sum over its pre-tokens; a pre-token of n symbols on
which m merges apply has n - m tokens, and no token identifier is ever made.
The lowest-rank adjacent pair (leftmost first) is popped from a heap, the two
symbols are joined in a linked list, and the new neighbours are pushed, so a
word of any length takes O(n log n).

Vocabulary files in the ``tokenizers`` JSON form are read, with these parts:
NFC, white space collapsed and lower case as the normaliser; a split on
contractions, letters, single digits and other runs; bytes as symbols; an end
mark on a word's last symbol.  Added special tokens found in a text count one
each.  Other forms are refused.

Counts of chunks between white space, and of the pre-tokens in them, are kept in
bounded caches per Python worker; emptying them changes nothing but the time.

Null text counts as empty: 0 tokens.  Rows with null or repeated ids are
counted as any other, one result per row.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's caches (chunks, pre-tokens), and the longest string kept in them.
CACHE_ENTRIES, WORD_ENTRIES = 300_000, 800_000
CACHED_CHARS = 48

# The pre-token pattern of the vocabulary file, without white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Characters that Python counts as white space and the file's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_counters: dict[str, "Counter"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Chunk to token count; computes what is missing."""

    def __init__(self, vocabulary: str):
        super().__init__()
        spec = json.loads(vocabulary)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("not a lower-case byte-pair vocabulary with word ends")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.end = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.symbols = byte_symbols()
        self.pieces = regex.compile(PIECES)
        self.words: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        symbol = [self.symbols[b] for b in word.encode()]
        symbol[-1] += self.end
        n = len(symbol)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(symbol, symbol[1:])) if p in rank]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = left + right, ""
            after[i] = k = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                if (pair := (symbol[i], symbol[k])) in rank:
                    heapq.heappush(heap, (rank[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (symbol[h], symbol[i])) in rank:
                heapq.heappush(heap, (rank[pair], h, *pair))
        return count

    def piece(self, word: str) -> int:
        """Tokens of one pre-token, from the cache if it is there."""
        count = self.words.get(word)
        if count is None:
            count = self.merged(word)
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= WORD_ENTRIES:
                    self.words.clear()
                self.words[word] = count
        return count

    def __missing__(self, chunk: str) -> int:
        plain = unicodedata.normalize("NFC", chunk)
        plain = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()
        count = sum(map(self.piece, self.pieces.findall(plain)))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = count
        return count

    def tokens(self, text: str) -> int:
        found = 0
        if any(s in text for s in self.special):
            found = len(self.find_special.findall(text))
            return found + sum(map(self.plain_tokens, self.find_special.split(text)))
        return self.plain_tokens(text)

    def plain_tokens(self, text: str) -> int:
        odd = any(c in text for c in SEPARATORS)
        chunks = regex.split(rf"[^\S{SEPARATORS}]+", text) if odd else text.split()
        return sum(map(self.__getitem__, chunks))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    The vocabulary is read once on the driver and sent to the workers; its size
    does not depend on the data.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(shared.value)
        tokens = _counters[vocabulary_path].tokens
        return pd.Series([tokens(t) if t else 0 for t in texts], dtype="int64")

    counted = docs.select(
        F.col(id_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        count(F.col(text_col)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
