"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: hashed word buckets (log counts, unit length),
one indicator per structure statistic (its bin among the training quantiles)
and one per metadata column (hashed logarithm of its value).  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost time linear in the non-zero entries.

The model is fitted on the driver from a bounded sample: at most
``max_train_rows`` labelled rows, the first by a hash of their id, each of at
most ``WORD_BUCKETS`` entries.  Rows of the held-out fold are never learned
from.  Scoring reads every whole text; ids, labels, language and source are no
inputs.

Defined cases: null text counts as empty and gets a score from the other
features.  Null metadata has a bucket of its own.  A null id is scored as any
row and is in the held-out fold.  Labels that are null are ignored; a document
labelled more than once has the larger label.  Without labels of both kinds the
score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pack

WORD_BUCKETS = 4096
BINS = 16
META_BUCKETS = 64
FACTORS = 8

MAX_TRAIN_ROWS = 8000
EPOCHS = 12
BATCH = 200
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3

#: Documents scored together; bounds the memory of the gathered factors.
SCORED_AT_ONCE = 256
#: Words whose bucket a worker remembers; forgetting changes only the time.
REMEMBERED = 300_000

STATS = (
    "log_bytes log_words word_bytes filled_buckets top_bucket log_lines repeated_lines "
    "upper digit punctuation marks spaces high stops"
).split()


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


_buckets = _Buckets()


def _byte_classes() -> np.ndarray:
    """Rows: upper, digit, punctuation, marks, space, high bytes, sentence ends."""
    table = np.zeros((7, 256))
    for b in range(256):
        c = chr(b)
        table[0, b] = "A" <= c <= "Z"
        table[1, b] = "0" <= c <= "9"
        table[2, b] = b < 128 and 32 < b and not c.isalnum()
        table[3, b] = c in "#$%&*|!<>{}[]=_~^@\\"
        table[4, b] = c in " \t\n\r\v\f"
        table[5, b] = b >= 128
        table[6, b] = c in ".,;:?"
    return table


_CLASSES = _byte_classes()


def word_entries(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values, and the structure statistics of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.lower().split()
    counts = np.bincount(np.fromiter(map(_buckets.__getitem__, words), dtype=np.int64, count=len(words)), minlength=WORD_BUCKETS)
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index]).astype(np.float32)
    if len(value):
        value /= np.sqrt((value * value).sum())
    lines = text.split("\n")
    size, n = max(len(data), 1), max(len(words), 1)
    classes = _CLASSES @ np.bincount(data, minlength=256) / size
    stats = [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n, len(index) / n, counts.max() / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), *classes,
    ]
    return index.astype(np.int32), value, [float(s) for s in stats]


@dataclass
class Model:
    """Fitted factorisation machine; ``constant`` replaces it where nothing can be learned."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def indicators(self, stats: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Feature numbers of the statistics' bins and of the metadata, per row."""
        bins = np.stack([np.searchsorted(e, s) for e, s in zip(self.edges, stats.T)], axis=1)
        first = WORD_BUCKETS + BINS * np.arange(len(STATS))
        own = WORD_BUCKETS + BINS * len(STATS) + META_BUCKETS * np.arange(meta.shape[1])
        return np.concatenate([first + bins, own + meta], axis=1)

    def raw(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; rows begin at ``at`` and are never empty."""
        part = self.factors[index] * value[:, None]
        linear = np.add.reduceat(self.weights[index] * value, at)
        pairs = np.add.reduceat(part, at) ** 2 - np.add.reduceat(part * part, at)
        return self.bias + linear + 0.5 * pairs.sum(axis=1)

    def scores(self, texts: list[str], meta: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        if self.constant is not None:
            out[:] = self.constant
            return out
        for a in range(0, len(texts), SCORED_AT_ONCE):
            got = [word_entries(t or "") for t in texts[a : a + SCORED_AT_ONCE]]
            more = self.indicators(np.array([g[2] for g in got]), meta[a : a + SCORED_AT_ONCE])
            each = np.float32(1 / np.sqrt(more.shape[1]))
            sizes = np.array([len(g[0]) + more.shape[1] for g in got])
            index = np.concatenate([x for g, m in zip(got, more) for x in (g[0], m)])
            value = np.concatenate([x for g in got for x in (g[1], np.full(more.shape[1], each, np.float32))])
            raw = self.raw(index, value, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            out[a : a + len(got)] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float], list[int]]], labels: np.ndarray, metas: int, seed: int = 7) -> Model:
    """Adam on the logistic loss in mini-batches; a fixed seed gives the same model each time."""
    edges = np.zeros((len(STATS), BINS - 1))
    share = float(labels.mean()) if len(labels) else 0.5
    size = WORD_BUCKETS + BINS * len(STATS) + META_BUCKETS * metas
    rng = np.random.default_rng(seed)
    model = Model(edges, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        model.constant = share
        return model
    stats = np.array([r[2] for r in rows])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    more = model.indicators(stats, np.array([r[3] for r in rows], dtype=np.int64).reshape(len(rows), metas))
    each = 1 / np.sqrt(more.shape[1])
    bias = np.array([np.log(share / (1 - share))])
    params = [bias, model.weights, model.factors]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            pick = order[a : a + BATCH]
            x = np.zeros((len(pick), size), np.float32)
            for i, r in enumerate(pick):
                x[i, rows[r][0]] = rows[r][1]
                x[i, more[r]] = each
            sums = x @ model.factors
            squares = x * x
            raw = bias[0] + x @ model.weights + 0.5 * (sums**2 - squares @ model.factors**2).sum(axis=1)
            wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            slopes = [
                np.array([wrong.sum()]),
                x.T @ wrong + DECAY * model.weights,
                x.T @ (wrong[:, None] * sums) - (squares.T @ wrong)[:, None] * model.factors + DECAY * model.factors,
            ]
            step += 1
            for p, g, (m, v) in zip(params, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    model.bias = float(bias[0])
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is in the fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _meta(cols: tuple[str, ...]) -> Column:
    """Bucket of each metadata column: the logarithm of its size, 0 for null."""
    each = [F.coalesce(F.least(F.floor(F.log2(F.abs(F.col(c).cast("double")) + 1)) + 1, F.lit(META_BUCKETS - 1)), F.lit(0)) for c in cols]
    return F.array(*[e.cast("int") for e in each]) if each else F.array().cast("array<int>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    meta_cols: tuple[str, ...] = ("n_chars",), max_train_rows: int = MAX_TRAIN_ROWS,
) -> Model:
    """Fit on at most ``max_train_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    each = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    sample = each.orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows)
    known = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), _meta(meta_cols).alias("_meta"))

    @F.pandas_udf("index binary, value binary, stats array<double>")
    def entries(texts: pd.Series) -> pd.DataFrame:
        got = ((index.tobytes(), value.tobytes(), stats) for index, value, stats in map(word_entries, texts))
        return pd.DataFrame(got, columns=["index", "value", "stats"])

    found = known.join(F.broadcast(sample), "_id").select(
        "_id", "_label", "_meta", F.crc32(F.col("_text").cast("binary")).alias("_crc"), entries("_text").alias("e")
    )
    rows = found.orderBy(F.xxhash64("_id"), "_id", "_crc", "_meta").limit(max_train_rows).collect()
    vectors = [(np.frombuffer(r.e["index"], np.int32), np.frombuffer(r.e["value"], np.float32), r.e["stats"], r["_meta"]) for r in rows]
    return fit(vectors, np.array([float(r["_label"]) for r in rows]), len(meta_cols))


def score_column(model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",)) -> Column:
    """Score between 0 and 1 of each row."""

    @F.pandas_udf("double")
    def score(texts: pd.Series, metas: pd.Series) -> pd.Series:
        meta = np.array(metas.tolist(), dtype=np.int64).reshape(len(texts), len(meta_cols))
        return pd.Series(model.scores(texts.tolist(), meta))

    return score(F.col(text_col), _meta(meta_cols))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, held_out, score and predicted (1 from ``THRESHOLD`` on) of every row."""
    model = train(docs, labels, id_col, **options)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the classifier predicts as label 1."""
    model = train(docs, labels, **options)
    return pack(docs, score=score_column(model)).where(F.col("score") >= THRESHOLD).select("row.*")
