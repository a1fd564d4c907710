"""Embedding whitening by mixed-precision eigenvectors.

Every entry c becomes the whole number x = floor(1024 c) + 100000.  Two
distributed passes give n, the sums S, and the covariance: with m the rounded
mean, z = x - m is small, so sums of z z^T per batch are exact in double
precision and are added as whole numbers.  The covariance is exact before its
one division by n^2, whatever the order of the rows.

Its eigenvectors start in single precision and are corrected by Ogita-Aishima
iterations (2018), made of matrix products in extended precision only:

    R = I - X'X,  T = X'VX,  l_i = T_ii / (1 - R_ii)
    E_ij = (T_ij + l_j R_ij) / (l_j - l_i),  or R_ij / 2 for close l_i, l_j
    X <- X + X E

Eigenvalues too close for the division form clusters; for each, the problem is
projected on the cluster's vectors, shifted by their mean value and solved
again (2019), and the iteration goes on with the turned vectors.

The driver holds dims x dims numbers, never rows.  Whitened values are computed
row by row and written; their covariance is then measured over all of them.

Defined cases: rows whose vector is null, holds null or non-finite entries, or
an entry beyond ``LARGEST``, are dropped.  Vectors shorter or longer than most
(on a tie: than the shortest of the most frequent lengths) have no place in the
covariance and are dropped too, as are empty ones.  Null and repeated ids are
rows as any other.  A component whose eigenvalue is zero to double precision
cannot be scaled: its whitened value is null, explained is its share (null if
the trace is zero), and identity_error, over the other components, is null
without any.  A deviation beyond a long is null.  No usable row: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from topicloom.runtime import materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this size are as good as infinite: sums of their x would leave the range of longs.
LARGEST = float(1 << 50)
EXACT_DOUBLE = float(1 << 53)
LONGEST = (1 << 63) - 1
ROWS_AT_ONCE = 4096
MAX_STEPS = 12


# --- eigenvectors ----------------------------------------------------------------


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of at least two positions of sorted ``values`` with steps of at most ``gap``."""
    cuts = np.flatnonzero(np.abs(np.diff(values)) > gap) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray, steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of a symmetric matrix from approximate ones.

    Stops when a correction is below the precision of doubles, or no longer shrinks.
    """
    a = matrix.astype(np.longdouble)
    x = vectors.astype(np.longdouble)
    one, last = np.eye(len(a), dtype=np.longdouble), np.inf
    norm = np.sqrt((a * a).sum())
    values = np.zeros(len(a), dtype=np.longdouble)
    for _ in range(steps):
        r = one - x.T @ x
        t = x.T @ (a @ x)
        r, t = (r + r.T) / 2, (t + t.T) / 2  # else rounding over a small gap costs orthogonality
        values = np.diag(t) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        r, t = r[np.ix_(order, order)], t[np.ix_(order, order)]
        off = t - np.diag(values)
        gap = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, (t + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        for run in clusters(values, gap):
            part = x[:, run]
            inner = part.T @ (a @ part) - values[run].mean() * (part.T @ part)
            inner = (inner + inner.T) / 2
            size = np.abs(inner).max()
            if size > 0:
                turn = np.linalg.eigh((inner / size).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
                x[:, run] = part @ turn
        change = np.inf if clusters(values, gap) else float(np.abs(e).max())
        if change < 1e-18 or np.inf > change >= last:
            break
        last = change
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.sqrt((x * x).sum(axis=0))[order]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors: single precision first, then refined."""
    size = np.abs(matrix).max() if matrix.size else 0
    if not size > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = (matrix / size).astype(np.longdouble)
    start = np.linalg.eigh(scaled.astype(np.float32))[1][:, ::-1]
    values, vectors = refine(scaled, start)
    return (values * size).astype(np.float64), vectors.astype(np.float64)


# --- exact sums ------------------------------------------------------------------


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """x of a batch of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(flat * SCALE).astype(np.int64) + OFFSET


def exact_square(z: np.ndarray) -> np.ndarray:
    """Sum of z z^T over the rows of ``z``, as Python's whole numbers if needed."""
    largest = int(np.abs(z).max()) if z.size else 0
    if float(largest) ** 2 * len(z) < EXACT_DOUBLE:
        return (z.T.astype(np.float64) @ z.astype(np.float64)).astype(np.int64).astype(object)
    big = z.astype(object)
    return big.T @ big


def covariance(n: int, sums: list[int], middle: list[int], squares: np.ndarray) -> np.ndarray:
    """V from exact sums: ``squares`` is the sum of (x - middle)(x - middle)^T."""
    rest = np.array([s - n * m for s, m in zip(sums, middle)], dtype=object)
    exact = n * squares - np.outer(rest, rest)
    head = exact.astype(np.float64)
    tail = (exact - np.vectorize(int, otypes=[object])(head)).astype(np.float64) if exact.size else head
    return (head.astype(np.longdouble) + tail.astype(np.longdouble)) / np.longdouble(n) / np.longdouble(n)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums per length and position."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in _pieces(batches):
        lengths = batch.column("dims").to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            x = whole_numbers(batch.filter(pa.array(lengths == dims)).column("vector"), dims)
            n, s = total.get(dims, (0, np.zeros(dims, dtype=object)))
            exact = x if float(np.abs(x).max()) * len(x) < EXACT_DOUBLE else x.astype(object)
            total[dims] = (n + len(x), s + exact.sum(axis=0).astype(object))
    for dims, (n, s) in total.items():
        rows = {"dims": [dims] * dims, "i": list(range(dims)), "n": [n] * dims, "s": [str(v) for v in s]}
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))


def _squares(middle: list[int]):
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, total = len(middle), None
        for batch in _pieces(batches):
            part = exact_square(whole_numbers(batch.column("vector"), dims) - np.array(middle, dtype=np.int64))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(dims)
            for at in range(0, len(i), 1 << 16):
                own = slice(at, at + (1 << 16))
                rows = {"i": i[own], "j": j[own], "g": [str(v) for v in total[i[own], j[own]]]}
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("g", pa.string())]))

    return squares


# --- the operator ----------------------------------------------------------------


@dataclass
class Whitening:
    """Fitted transform: ``values`` and ``vectors`` (columns) of the first components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > np.finfo(float).eps * max(self.dims, 1) * (self.values[0] if len(self.values) else 0)

    def middle(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def transform(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values (NaN for a component of zero) and exact deviations of whole-number rows."""
        z = x - np.array(self.middle(), dtype=np.int64)
        rest = [s - self.n * m for s, m in zip(self.sums, self.middle())]
        centred = z.astype(np.float64) - np.array([float(r) for r in rest]) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            white = np.where(self.usable(), centred @ self.vectors / np.sqrt(self.values), np.nan)
        top = (int(np.abs(z).max()) + 1) * self.n if z.size else 0
        kind = np.int64 if top * top * max(self.dims, 1) <= LONGEST else object
        moved = self.n * z.astype(kind) - np.array(rest, dtype=kind)
        return white, [int(v) if v <= LONGEST else None for v in (moved * moved).sum(axis=1)]


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dims and vector (doubles) of the rows that can be whitened."""
    wide = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return wide.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd).select("id", F.size("vector").alias("dims"), "vector")


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows that ``usable_rows`` gave; None without any."""
    partial = rows.select("dims", "vector").mapInArrow(_sums, "dims int, i int, n long, s string")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    totals = materialize(partial.groupBy("dims", "i").agg(F.sum("n").alias("n"), exact("s")), "sums")
    first = totals.where("i = 0").orderBy(F.desc("n"), "dims").first()
    if first is None:
        return None
    dims, n = first["dims"], first["n"]
    sums = [int(r["s"]) for r in totals.where(F.col("dims") == dims).orderBy("i").collect()]
    model = Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    own = rows.where(F.col("dims") == dims).select("vector")
    parts = own.mapInArrow(_squares(model.middle()), "i int, j int, g string")
    squares = np.zeros((dims, dims), dtype=object)
    for r in parts.groupBy("i", "j").agg(exact("g")).collect():  # dims x dims / 2 numbers
        squares[r["i"], r["j"]] = squares[r["j"], r["i"]] = int(r["g"])
    matrix = covariance(n, sums, model.middle(), squares)
    values, turned = eigen(matrix)
    model.values, model.vectors, model.trace = values[:components], turned[:, :components], float(np.trace(matrix))
    return model


def _whitened(model: Whitening):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            white, deviation = model.transform(whole_numbers(batch.column("vector"), model.dims))
            ends = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "white"])

    return whitened


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and products of whitened values; null components count as zero."""
    total = None
    for batch in _pieces(batches):
        white = batch.column("white").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        one = np.concatenate([np.ones((len(white), 1)), np.nan_to_num(white)], axis=1)
        total = one.T @ one if total is None else total + one.T @ one
    if total is not None:
        i, j = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "m": total.ravel()})


def identity_error(written: DataFrame, usable: np.ndarray) -> float | None:
    """Largest entry of the whitened values' covariance minus the identity, measured over all rows."""
    parts = written.select("white").mapInArrow(_moments, "i int, j int, m double")
    size = len(usable) + 1
    moments = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("m").alias("m")).collect():  # components squared
        moments[r["i"], r["j"]] = r["m"]
    if not usable.any():
        return None
    mean = moments[0, 1:] / moments[0, 0]
    found = moments[1:, 1:] / moments[0, 0] - np.outer(mean, mean)
    return float(np.abs(found - np.eye(len(usable)))[np.ix_(usable, usable)].max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error per usable row and component."""
    rows = usable_rows(vectors, id_col, vector_col)
    id_type = rows.schema["id"].dataType
    model = fit_whitening(rows, components)
    if model is None:
        names = [(id_col, id_type), ("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]
        return vectors.sparkSession.createDataFrame([], StructType([StructField(n, t) for n, t in names]))
    own = rows.where(F.col("dims") == model.dims).select("id", "vector")
    schema = StructType([StructField("id", id_type), StructField("deviation", LongType()), StructField("white", ArrayType(DoubleType()))])
    written = materialize(own.mapInArrow(_whitened(model), schema), "whitened")
    error = identity_error(written, model.usable())
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at"))
    return written.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
