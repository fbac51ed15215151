"""Whitening of embeddings by a two-pass covariance.

The first pass adds up integers exactly and gives the mean.  The second centres every vector, as (n x - S) / n with an exact
numerator, adds up outer products by one matrix product per block of vectors, and merges the tasks' matrices by treeAggregate.  The driver takes
the symmetric eigendecomposition by LAPACK and hands the projection out to all tasks; it holds d * d numbers, whatever the number of vectors.

Results of odd inputs: null vectors and those with null or non-finite entries are left out, and so are empty ones and those of another
length than the commonest (the longest of equally common ones), as no covariance holds them; repeated rows and null ids count once per
row; directions without variance, which no scaling makes one, have no component; no vectors, or equal ones only, give no rows; an entry or
a deviation beyond exact integers raises an error; columns other than the two needed are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, let

#: Numbers in a block of vectors that is worked on at once.
BLOCK = 1 << 20


def integer_vectors(df: DataFrame, scale: int = 1024, shift: int = 100_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of the vectors without null or non-finite entries."""

    def exact(c):
        return let(c.cast("double") * scale, lambda y: F.when(F.abs(y) < float(2**31), F.floor(y) + shift).otherwise(F.raise_error(F.lit("entry too large for exact sums")).cast("bigint")))

    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter((F.size(column) > 0) & fine).select(F.col(key).alias("vec_id"), F.transform(column, exact).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // max(1, d))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """(number, sums by dimension) of the vectors of the commonest length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = {}, {}
        for batch in batches:
            lengths = pc.list_value_length(batch["x"])
            for d in pc.unique(lengths).to_pylist():
                x = _matrix(batch["x"].filter(pc.equal(lengths, d)))
                n[d], s[d] = n.get(d, 0) + len(x), s.get(d, 0) + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array(list(s.values()), pa.list_(pa.int64()))], names=["d", "n", "sums"])

    part = cut(vectors.select("x").mapInArrow(work, "d int, n bigint, sums array<bigint>"), "sums")
    most = part.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    rows = part.filter(F.col("d") == most.d).select(F.posexplode("sums").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("x")).collect()  # a row per dimension
    return most.n, np.array([r.x for r in sorted(rows, key=lambda r: r.dim)], np.int64)


@dataclass(frozen=True)
class Whitening:
    """Of a fit: number of vectors, their sums, the largest eigenvalues of their covariance with unit eigenvectors as columns, and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, scaled: np.ndarray) -> np.ndarray:
        return (scaled / self.n) @ (self.vectors / np.sqrt(self.values))


def _tree(vectors: DataFrame, add_up, d: int, merge, zero):
    """One matrix per task by ``add_up`` of its blocks, merged in a tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = zero
        for batch in batches:
            for part in _blocks(batch, d):
                found = merge(found, add_up(_matrix(part["x"])))
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())], names=["m"])

    shape = zero.shape
    return vectors.select("x").mapInArrow(work, "m binary").rdd.map(lambda r: np.frombuffer(r.m).reshape(shape)).treeAggregate(zero, merge, merge)


def fit(vectors: DataFrame, components: int = 8) -> Whitening:
    """The whitening of ``vectors`` (vec_id, x): at most ``components`` directions of falling variance.  A direction's sign is such that
    its entry of largest size is positive."""
    n, s = exact_sums(vectors)
    d = len(s)
    if not n:
        return Whitening(0, s, np.zeros(0), np.zeros((0, 0)), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        centred = (n * x - s) / n
        return centred.T @ centred

    total = _tree(vectors.filter(F.size("x") == d), outer, d, lambda a, b: a + b, np.zeros((d, d)))
    values, directions = np.linalg.eigh(total / n)
    values, directions = values[::-1], directions[:, ::-1]
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps
    values, directions = values[real][:components], directions[:, real][:, :components]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(values))])
    return Whitening(n, s, values, directions * signs, float(np.trace(total) / n))


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, by size, of the whitened vectors' covariance minus the identity.  Blocks are centred on their own means and merged
    with the means' difference, so nothing is multiplied uncentred."""
    d, k = len(w.sums), len(w.values)
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        """Rows: number in the first entry; means; centred products."""
        y = w.whitened(w.scaled(x))
        m = y.mean(axis=0)
        return np.vstack([np.full((1, k), len(y)), m[None], (y - m).T @ (y - m)])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, away = a[0, 0] + b[0, 0], b[1] - a[1]
        if not n:
            return a
        return np.vstack([np.full((1, k), n), (a[1] + away * b[0, 0] / n)[None], a[2:] + b[2:] + np.outer(away, away) * (a[0, 0] * b[0, 0] / n)])

    m = _tree(vectors.filter(F.size("x") == d), moments, d, merge, np.zeros((k + 2, k)))
    return float(np.abs(m[2:] / m[0, 0] - np.eye(k)).max())


def project(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained), a row for each vector of the fit's length and component; deviation is the
    exact sum of (n x - S)^2."""
    d, k = len(w.sums), len(w.values)
    held = vectors.sparkSession.sparkContext.broadcast(w)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        share = w.values / w.trace
        for batch in batches:
            for part in _blocks(batch, max(d, 8 * k)):
                rows = w.scaled(_matrix(part["x"]))
                about = rows.astype(np.float64)
                if (np.einsum("ij,ij->i", about, about) > 2.0**63 * (1 - 1e-9)).any():
                    raise OverflowError("a deviation is beyond 64 bits")
                size = len(rows)
                yield pa.RecordBatch.from_arrays([
                    part["vec_id"].take(pa.array(np.repeat(np.arange(size), k))), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, w.n), pa.int64()),
                    pa.array(np.repeat(np.einsum("ij,ij->i", rows, rows), k), pa.int64()), pa.array(w.whitened(rows).ravel()), pa.array(np.tile(share, size)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    schema = T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double").fields])
    return vectors.filter(F.size("x") == d).mapInArrow(work, schema)


def whiten(vectors: DataFrame, components: int = 8) -> tuple[DataFrame, Whitening]:
    """(project() with identity_error, the fit) of ``vectors``, which are written out once and read by every pass."""
    x = cut(vectors.select("vec_id", "x"), "integers")
    w = fit(x, components)
    return project(x, w).withColumn("identity_error", F.lit(identity_error(x, w))), w
