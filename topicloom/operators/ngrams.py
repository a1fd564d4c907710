"""N-gram counting and the merge of short n-grams into longer ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.stopwords import ENGLISH
from topicloom.functions.text import distinct_words, let, ngrams, tokenize, word_count
from topicloom.operators.scoring import max_scale
from topicloom.runtime import BROADCAST_BYTES, materialize, total

MIN_FEATURE_CHARS = 3


#: Bounds on the map of frequent n-grams, in bits; the upper one is the broadcast limit.
MIN_BITS = 1 << 16
MAX_BITS = 8 * BROADCAST_BYTES
BITS_PER_FEATURE = 16
#: Bits of the map that one row brings to the driver.
BLOCK_BITS = 1 << 16
#: Tokens that a task counts at once, or one text if it has more.
TOKENS_AT_ONCE = 1 << 20


def _flagged(grams: Column) -> Column:
    """Sorted array of (feature, first): first is 1 once per distinct n-gram."""

    def flag(g: Column) -> Column:
        return F.transform(
            g,
            lambda x, i: F.struct(
                x.alias("feature"),
                F.when((i > 0) & (x == F.get(g, i - 1)), 0).otherwise(1).alias("first"),
            ),
        )

    return let(F.sort_array(grams), flag)


def _counted(df: DataFrame, grams: Column, by: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    # the outer form: the plain one adds a filter that computes the array twice
    listed = df.select(*by, F.inline_outer(_flagged(grams))).where(F.col("feature").isNotNull())
    if among is not None:
        listed = listed.join(among.select("feature"), "feature", "left_semi")
    return (
        listed.groupBy(*by, "feature")
        .agg(F.count(F.lit(1)).alias("frequency"), F.sum("first").alias("doc_frequency"))
    )


def count_ngrams(
    df: DataFrame,
    text_col: str = "query",
    ngram_range: tuple[int, int] = (1, 5),
    stop_words: Iterable[str] = ENGLISH,
    by: tuple[str, ...] = (),
    among: DataFrame | None = None,
) -> DataFrame:
    """Occurrences and document frequency per n-gram (and per ``by`` columns).

    ``among`` (feature) names the n-grams to count.  As a written table that
    Spark broadcasts by its size, it drops the others before the shuffle.

    Each row's n-grams are sorted inside the row and the first of every run of
    equal ones is flagged, so one partially aggregated shuffle gives both
    numbers, with no (document, n-gram) shuffle before it.
    """
    lo, hi = ngram_range
    return _counted(df, ngrams(tokenize(F.col(text_col), stop_words), lo, hi), by, among)


class Seen:
    """Hashed set of n-grams as a bitmap, sized by their number; it may hold others by chance."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def slots(features: Iterable[str], bits: int) -> np.ndarray:
        hashed = pd.util.hash_array(np.asarray(features, dtype=object), categorize=False)
        return (hashed & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def of(cls, features: DataFrame) -> Seen:
        """From a written table; the driver gets at most ``MAX_BITS`` bits."""
        wanted = features.count() * BITS_PER_FEATURE
        bits = min(MAX_BITS, max(MIN_BITS, 1 << max(wanted - 1, 1).bit_length()))
        slots = cls.slots

        @F.pandas_udf("long")
        def slot(names: pd.Series) -> pd.Series:
            return pd.Series(slots(names, bits))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            marks = np.zeros(BLOCK_BITS, dtype=np.uint8)
            marks[pdf["at"].to_numpy() % BLOCK_BITS] = 1
            return pd.DataFrame({"i": [int(pdf["at"].iloc[0]) // BLOCK_BITS], "w": [np.packbits(marks, bitorder="little").tobytes()]})

        at = features.select(slot("feature").alias("at"))
        filled = at.groupBy(F.floor(F.col("at") / BLOCK_BITS)).applyInPandas(fill, "i long, w binary")
        words = np.zeros(bits // 64, dtype=np.int64)
        for row in filled.toLocalIterator():  # one packed block at a time, whatever the number of n-grams
            words[row["i"] * BLOCK_BITS // 64 :][: BLOCK_BITS // 64] = np.frombuffer(row["w"], np.dtype("<i8"))
        return cls(words)

    def holds(self, features: pa.Array) -> np.ndarray:
        at = self.slots(features.to_numpy(zero_copy_only=False), 64 * len(self.words))
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The tokens of some rows one after the other, and each one's row."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lists):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
            part = lists.slice(at, end - at)
            sizes = np.diff(ends[at:end], prepend=before)
            yield part.flatten(), np.repeat(np.arange(end - at), sizes)
            at = end


def _counts(ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id occurs, and in how many rows."""
    pairs = pc.unique(pa.array(rows.astype(np.int64) * n + ids)).to_numpy()  # by hash, not by sorting
    return np.bincount(ids, minlength=n), np.bincount(pairs % n, minlength=n)


def shared_maps(tokens: DataFrame, words: Seen | None = None, pairs: Seen | None = None) -> Broadcast:
    return tokens.sparkSession.sparkContext.broadcast([s and s.words for s in (words, pairs)])


def count_runs(tokens: DataFrame, sizes: range, words: Seen | None = None, pairs: Seen | None = None, known: Broadcast | None = None) -> DataFrame:
    """feature, frequency, doc_frequency of the runs of ``sizes`` tokens; ``tokens`` has one array column.

    Only runs of words in ``words`` whose pairs are all in ``pairs`` are
    counted.  A task numbers its words and runs and sums whole blocks of rows
    before they reach the shuffle.  ``known`` may pass both maps broadcast.
    """
    known = known or shared_maps(tokens, words, pairs)
    lo, hi = sizes[0], sizes[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (None if w is None else Seen(w) for w in known.value)
        for flat, rows in _pieces(batches):
            coded = flat.dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(codes):
                continue
            good = np.ones(len(codes), dtype=bool) if words is None else words.holds(names)[codes]
            at = np.flatnonzero(good)  # where a run starts, its number and its text
            ids, texts = codes[at], names
            for n in range(1, hi + 1):
                if n > 1:
                    next_ = at + n - 1
                    fits = next_ < len(codes)
                    fits[fits] = good[next_[fits]] & (rows[next_[fits]] == rows[at[fits]])
                    if n > 2:  # the last two words of the run are a known pair
                        fits[fits] = paired[next_[fits] - 1]
                    at, ids = at[fits], ids[fits]
                    runs = pa.array(ids * len(names) + codes[at + n - 1]).dictionary_encode()
                    whole, ids = runs.dictionary.to_numpy(), runs.indices.to_numpy().astype(np.int64)
                    texts = pc.binary_join_element_wise(texts.take(pa.array(whole // len(names))), names.take(pa.array(whole % len(names))), " ")
                    if n == 2 and hi > 2:
                        kept = np.ones(len(texts), dtype=bool) if pairs is None else pairs.holds(texts)
                        paired = np.zeros(len(codes), dtype=bool)
                        paired[at] = kept[ids]
                        if lo > 2:
                            at, ids = at[kept[ids]], ids[kept[ids]]
                if n >= lo and len(ids):
                    times, docs = _counts(ids, rows[at], len(texts))
                    some = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays(
                        [texts.take(pa.array(some)), pa.array(times[some]), pa.array(docs[some])], ["feature", "frequency", "doc_frequency"]
                    )

    found = tokens.mapInArrow(count, "feature string, frequency long, doc_frequency long")
    return found.groupBy("feature").agg(F.sum("frequency").alias("frequency"), F.sum("doc_frequency").alias("doc_frequency"))


def frequent_ngrams(
    df: DataFrame, text_col: str, ngram_range: tuple[int, int], min_docs: Column,
    stop_words: Iterable[str],
) -> DataFrame:
    """``count_ngrams`` limited to those in at least ``min_docs`` documents, level by level.

    Every part of a frequent n-gram is frequent.  Texts are tokenized once;
    words are counted first, then pairs of frequent words, then longer runs of
    frequent pairs, so rare n-grams, most of all there are, never reach a
    shuffle.  The frequent ones of a level go out as a bitmap sized by their
    number; a false hit in it only costs a count that the exact filter drops.
    """
    lo, hi = ngram_range
    tokens = materialize(df.select(tokenize(F.col(text_col), stop_words).alias("tokens")), "tokens")
    enough = F.col("doc_frequency") >= min_docs

    def level(label: str, sizes: range, *maps: Seen) -> DataFrame:
        known = shared_maps(tokens, *maps)
        counted = materialize(count_runs(tokens, sizes, known=known).where(enough), label)
        known.destroy()  # the level is written
        return counted

    found = [level("words", range(1, 2))]
    if hi >= 2:
        words = Seen.of(found[0])
        found.append(level("pairs", range(2, 3), words))
    if hi >= 3:
        found.append(level("longer", range(3, hi + 1), words, Seen.of(found[1])))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    if lo > 1:
        out = out.where(word_count(F.col("feature")) >= lo)
    return out


def ngram_frequency(
    df: DataFrame,
    text_col: str = "query",
    ngram_range: tuple[int, int] = (1, 5),
    min_df: int | float = 5,
    stop_words: Iterable[str] = ENGLISH,
    by_level: bool = True,
) -> DataFrame:
    """N-gram counts: feature, frequency.

    ``min_df`` is a number of documents, or a share of them when a float.
    Features shorter than three characters are dropped, and features that
    repeat a word are folded into the feature without the repeat.  ``by_level``
    prunes rare n-grams before they are shuffled, for one more pass over the
    texts per level.
    """
    if isinstance(min_df, float):
        docs = total(df, F.count(F.col(text_col)).cast("double"))
        min_docs = F.lit(min_df) * docs
    else:
        min_docs = F.lit(min_df)
    if by_level and ngram_range[1] > 1 and min_df > (0.0 if isinstance(min_df, float) else 1):
        kept = frequent_ngrams(df, text_col, ngram_range, min_docs, stop_words)
    else:
        counts = count_ngrams(df, text_col, ngram_range, stop_words)
        kept = counts.where(F.col("doc_frequency") >= min_docs)
    return (
        kept.where(F.length("feature") >= MIN_FEATURE_CHARS)
        .groupBy(distinct_words(F.col("feature")).alias("feature"))
        .agg(F.sum("frequency").alias("frequency"))
    )


def merge_ngrams(counts: DataFrame) -> DataFrame:
    """Take from each n-gram what the next longer ones that hold it account for.

    merged(g) = max(0, f(g) - sum of f(h)) over every h one word longer that
    holds g as a contiguous run and has f(h) <= f(g).  A longer n-gram has just
    two runs of the smaller size.  They are first counted per (run, f(h)), so a
    word inside millions of n-grams meets its own row as a few count values.
    Both frequencies are then divided by the maximum of the rows that remain.
    """
    sized = counts.select("feature", "frequency", word_count(F.col("feature")).alias("ngram_size"))
    words = F.split("feature", " ")
    n = F.col("ngram_size")
    head = F.array_join(F.slice(words, F.lit(1), n - 1), " ")
    tail = F.array_join(F.slice(words, F.lit(2), n - 1), " ")
    taken = (
        sized.where(n > 1)
        .select(
            F.explode(F.array_distinct(F.array(head, tail))).alias("feature"),
            F.col("frequency").alias("_larger"),
        )
        .groupBy("feature", "_larger")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    taken_sum = F.sum(
        F.when(F.col("_larger") <= F.col("frequency"), F.col("_larger") * F.col("_times"))
    )
    merged = (
        sized.join(taken, "feature", "left")
        .groupBy("feature")
        .agg(
            F.first("ngram_size").alias("ngram_size"),
            F.first("frequency").alias("frequency"),
            F.coalesce(taken_sum, F.lit(0)).alias("_taken"),
        )
        .withColumn("merged_frequency", F.greatest(F.lit(0), F.col("frequency") - F.col("_taken")))
        .where("merged_frequency > 0")
        .select("ngram_size", "feature", "merged_frequency", "frequency")
    )
    return max_scale(merged, "merged_frequency", "frequency")
