"""Toxicity: a sparse linear classifier that identity terms may not move.

A document is a sparse vector of log counts: one hashed bucket per word and one
per word beginning of 4, 5, 6 and 7 letters, so that forms of one stem count
together.  The score is the sigmoid of a linear function of them.

Identity terms are swapped in the sentences of the labelled documents: each
term of a sentence gives way to another one of its kind, or to the kind's
neutral word, drawn by a hash of the sentence.  The loss is

    log loss + l1 * |w| + penalty * mean over swaps of (logit(x) - logit(x'))^2

so a term that happens to stand in toxic rows cannot carry their score, and a
neutral mention of a group is scored as the same sentence about anyone.  Words
that no kind lists are not touched.

The model is fitted on the driver from a bounded sample: at most
``max_train_rows`` labelled rows, the first by a hash of their id, each with at
most ``SWAPS_PER_ROW`` swapped sentences (the first by a hash).  Executors turn
them into packed numbers; texts do not travel.  Proximal steps leave most
weights at zero, so scoring, which reads every whole text, looks up only words
that matter.  Ids, labels, language and source are no inputs.

Defined cases: null text counts as empty; an empty text scores the sigmoid of
the bias.  A null id is scored as any row and is in the held-out fold.  Labels
that are null are ignored; a document labelled more than once has the larger
label.  Rows with equal ids, and equal rows, are scored one by one.  Without
labels of both kinds every score is the share of label 1, or 0 without any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pack
from topicloom.llm.quality import held_out

BUCKETS = 1 << 16
STEMS = (4, 5, 6, 7)
MARKS = ".,;:!?\"'()[]|"

MAX_TRAIN_ROWS = 8000
SWAPS_PER_ROW = 8
EPOCHS = 20
BATCH = 200
RATE = 0.03
L1 = 2e-4
PENALTY = 2.0
THRESHOLD = 0.5
SEED = 12

#: Words whose features a task remembers; forgetting changes only the time.
REMEMBERED = 400_000
#: Words of one text that are looked up together; bounds the memory of a long one.
STRIPE = 1 << 16

#: Terms that name a group of people, by kind; the first of a kind is its neutral word.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "faith": (
        "religious", "christian", "catholic", "protestant", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist",
    ),
    "believers": ("people", "christians", "catholics", "muslims", "jews", "hindus", "buddhists", "atheists"),
    "origin": (
        "local", "black", "white", "asian", "african", "european", "american", "mexican", "arab", "chinese", "indian",
        "turkish", "latino",
    ),
    "arrival": ("residents", "immigrants", "refugees", "foreigners", "natives"),
    "gender": ("person", "woman", "man", "girl", "boy", "lady", "guy"),
    "genders": ("people", "women", "men", "girls", "boys", "ladies", "guys"),
    "orientation": ("young", "gay", "lesbian", "bisexual", "straight", "queer", "transgender", "heterosexual", "homosexual"),
    "body": ("tall", "deaf", "blind", "disabled", "elderly", "old"),
    "german faith": ("gläubig", "christlich", "muslimisch", "jüdisch", "katholisch", "evangelisch"),
    "german people": ("leute", "christen", "muslime", "juden", "frauen", "männer", "ausländer", "flüchtlinge"),
    "french people": ("gens", "chrétiens", "musulmans", "juifs", "femmes", "hommes", "étrangers", "réfugiés"),
    "spanish people": ("personas", "cristianos", "musulmanes", "judíos", "mujeres", "hombres", "extranjeros", "refugiados"),
}

SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    code = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS]
    return code + [zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) % BUCKETS for k in STEMS if len(word) >= k]


class _Lookup(dict):
    """Row of a raw word in a table of feature slots; words without a slot share row 0.

    ``slots`` gives the slot of each bucket, ``none`` for a bucket without one.
    """

    def __init__(self, slots: list[int], none: int):
        super().__init__()
        self.slots, self.none = slots, none
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.used = 1
        self.table = np.full((1024, 1 + len(STEMS)), self.none, dtype=np.int32)

    def __missing__(self, raw: str) -> int:
        found = [s for s in map(self.slots.__getitem__, word_features(raw.strip(MARKS))) if s != self.none]
        row = 0
        if found:
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, self.none)])
            row = self.used
            self.table[row, : len(found)] = found
            self.used += 1
        self[raw] = row
        return row

    def counts(self, text: str) -> np.ndarray:
        """How often each slot occurs in a text."""
        words, total = text.lower().split(), np.zeros(self.none + 1, dtype=np.int64)
        for at in range(0, len(words), STRIPE):
            part = words[at : at + STRIPE]
            if len(self) > REMEMBERED:
                self.forget()
            rows = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            total += np.bincount(self.table[rows[rows > 0]].ravel(), minlength=self.none + 1)
        return total[:-1]


def every_bucket() -> _Lookup:
    return _Lookup(list(range(BUCKETS)), BUCKETS)


def _kind_of(terms: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """The kind of each term but the neutral ones, which are swapped for but never swapped out."""
    return {term: tuple(kind) for kind in terms.values() for term in kind[1:]}


def swapped_sentences(text: str, terms: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(sentence, the same with its identity terms swapped) for sentences that hold some."""
    kinds = _kind_of(terms)
    out = []
    for match in SENTENCE.finditer(text.lower()):
        words, changed = match.group().split(), False
        draw = zlib.crc32(match.group().encode("utf-8", "surrogatepass"))
        for at, raw in enumerate(words):
            word = raw.strip(MARKS)
            others = [o for o in kinds.get(word, ()) if o != word]
            if others:
                words[at], changed = others[(draw + at) % len(others)], True
        if changed:
            out.append((match.group(), " ".join(words)))
    return sorted(out, key=lambda s: zlib.crc32(s[0].encode("utf-8", "surrogatepass")))


def row_entries(text: str, lookup: _Lookup, terms: Mapping[str, Sequence[str]]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Buckets and log counts of a text, and how each swap changes them."""
    counts = lookup.counts(text)
    index = np.flatnonzero(counts)
    swaps = []
    for old, new in swapped_sentences(text, terms)[:SWAPS_PER_ROW]:
        moved = lookup.counts(new) - lookup.counts(old)
        at = np.flatnonzero(moved)
        swaps.append((at.astype(np.int32), np.log1p(np.maximum(counts[at] + moved[at], 0)) - np.log1p(counts[at])))
    return index.astype(np.int32), np.log1p(counts[index]), swaps


@dataclass
class Model:
    """Fitted classifier; ``constant`` replaces it where nothing can be learned."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    constant: float | None = None

    def lookup(self) -> _Lookup:
        """Slots of the buckets that have a weight."""
        used = np.flatnonzero(self.weights)
        slots = np.full(BUCKETS, len(used))
        slots[used] = np.arange(len(used))
        return _Lookup(slots.tolist(), len(used))

    def scores(self, texts: Sequence[str | None], lookup: _Lookup | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        lookup, weights = lookup or self.lookup(), self.weights[self.weights != 0]
        raw = np.array([self.bias + np.log1p(lookup.counts(t or "")) @ weights for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class _Rows:
    """Sparse rows side by side."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.index = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)]).astype(np.int64)
        self.value = np.concatenate([np.zeros(0), *(r[1] for r in rows)])
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows]) if rows else np.zeros(0, np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, minlength=self.n)

    def back(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * each[self.row], minlength=BUCKETS)


def slopes(weights: np.ndarray, bias: float, rows: _Rows, labels: np.ndarray, swaps: _Rows, penalty: float) -> tuple[np.ndarray, float]:
    """Gradient of the log loss and the swap penalty over one batch."""
    raw = bias + rows.times(weights)
    wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels) / rows.n
    by_weight = rows.back(wrong)
    if swaps.n:
        by_weight = by_weight + swaps.back(2 * penalty * swaps.times(weights) / swaps.n)
    return by_weight, float(wrong.sum())


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, list]], labels: np.ndarray, penalty: float = PENALTY, l1: float = L1, seed: int = SEED) -> Model:
    """Proximal Adam in mini-batches; a fixed seed gives the same model each time."""
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.0)
    rng, step = np.random.default_rng(seed), 0
    weights, share = np.zeros(BUCKETS), float(labels.mean())
    bias = float(np.log(share / (1 - share)))
    mean, square = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            batch = _Rows([rows[i][:2] for i in pick])
            swaps = _Rows([s for i in pick for s in rows[i][2]])
            by_weight, by_bias = slopes(weights, bias, batch, labels[pick], swaps, penalty)
            step += 1
            mean += 0.1 * (by_weight - mean)
            square += 0.001 * (by_weight * by_weight - square)
            size = RATE / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            moved = weights - size * mean / (1 - 0.9**step)
            weights = np.sign(moved) * np.maximum(np.abs(moved) - size * l1, 0)
            bias -= RATE * by_bias
    return Model(bias, weights)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS, penalty: float = PENALTY, max_train_rows: int = MAX_TRAIN_ROWS,
) -> Model:
    """Fit on at most ``max_train_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    each = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    sample = each.orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows)
    known = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    @F.pandas_udf("struct<index:binary,value:binary,swaps:array<struct<index:binary,value:binary>>>")
    def entries(texts: pd.Series) -> pd.DataFrame:
        lookup = every_bucket()
        got = []
        for index, value, swaps in (row_entries(t, lookup, terms) for t in texts):
            packed = [{"index": i.astype(np.int32).tobytes(), "value": v.tobytes()} for i, v in swaps]
            got.append((index.tobytes(), value.astype(np.float32).tobytes(), packed))
        return pd.DataFrame(got, columns=["index", "value", "swaps"])

    found = known.join(F.broadcast(sample), "_id").select(
        "_id", "_label", F.crc32(F.col("_text").cast("binary")).alias("_crc"), entries("_text").alias("e")
    )
    rows = found.orderBy(F.xxhash64("_id"), "_id", "_crc").limit(max_train_rows).collect()
    vectors = [
        (
            np.frombuffer(r.e["index"], np.int32), np.frombuffer(r.e["value"], np.float32),
            [(np.frombuffer(s["index"], np.int32), np.frombuffer(s["value"])) for s in r.e["swaps"]],
        )
        for r in rows
    ]
    return fit(vectors, np.array([float(r["_label"]) for r in rows]), penalty)


def score_column(model: Model, text_col: str = "text") -> Column:
    """Score between 0 and 1 of each row."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = model.lookup()
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist(), lookup))

    return score(F.col(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score and predicted (1 from ``THRESHOLD`` on) of every row."""
    model = train(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not predicted toxic."""
    model = train(docs, labels, id_col, text_col, **options)
    return pack(docs, score=score_column(model, text_col)).where(F.col("score") < THRESHOLD).select("row.*")
