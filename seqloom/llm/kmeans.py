"""K-means over integer vectors by exponion search.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other one.  After
an update the bounds are loosened by how far the centroids moved.  A vector whose upper bound is below its lower bound, or below
half the distance from its centroid to the nearest other one, keeps its centroid unseen.  Any other vector, at distance u
of its centroid c, is compared with the centroids in the closed ball around c of radius 2 u + (distance from c to its nearest neighbour):
both its nearest and its second nearest centroid are inside.  Each centroid has the list of the others, sorted by distance, so that a
ball is a prefix of a list.  Bounds are floating point with a margin and only decide what is looked at; what is compared are exact integers,
and a bound that is merely reached is looked at, so ties always go to the smaller number.

Results of odd inputs: nulls, non-finite components and other lengths are left out by integer_vectors(); a component too large
for exact distances raises an error; repeated rows and ids count once per row; a null id is assigned like any other and is drawn as a seed
last; fewer vectors than ``k`` give as many centroids; no vectors give no rows; columns other than the two needed are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, let

#: Relative margin of the floating-point bounds.
MARGIN = 1e-9
#: Numbers in a block of vectors that is worked on at once.
BLOCK = 1 << 20


def integer_vectors(df: DataFrame, scale: int = 64, dim: int = 64, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with ``dim`` components, none of them null or non-finite."""
    most = float(int((2**60 / dim) ** 0.5))  # dim * (2 * most)^2 fits into 62 bits

    def exact(x):
        return let(x.cast("double") * scale, lambda y: F.when(F.abs(y) < most, F.floor(y).cast("int")).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("int")))

    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter((F.size(column) == dim) & fine).select(F.col(key).alias("vec_id"), F.transform(column, exact).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str = "1") -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt:id``, in that order; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("name")
    first = vectors.select(name, "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64) if first else np.empty((0, 0), np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """What a search needs to know of the centroids: of each one the others by distance, and how far it moved.  k * k numbers."""

    def __init__(self, c: np.ndarray, moved: np.ndarray):
        k = len(c)
        gaps = np.sqrt(np.array([_squares(c, x) for x in c], np.float64)).reshape(k, k)
        np.fill_diagonal(gaps, np.inf)
        self.c, self.moved = c, moved
        self.others = np.argsort(gaps, axis=1, kind="stable")[:, : k - 1].astype(np.int32)
        self.gaps = np.take_along_axis(gaps, self.others, 1) if k > 1 else np.empty((k, 0))
        self.near = self.gaps[:, 0] if k > 1 else np.full(k, np.inf)
        top = np.sort(moved)[::-1]
        self.rest = np.where((moved == top[0]) & ((moved == top[0]).sum() == 1), top[1] if k > 1 else 0.0, top[0])

    def search(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New (centroids, upper bounds, lower bounds, distances computed) of the vectors ``x``."""
        a, u, low = a.copy(), u + self.moved[a], low - self.rest[a]
        seen = np.zeros(len(x), np.int64)
        open_ = lambda at: ~(u[at] * (1 + MARGIN) < np.maximum(low[at], self.near[a[at]] / 2) * (1 - MARGIN))
        at = np.flatnonzero(open_(np.arange(len(x))))
        own = _squares(x[at], self.c[a[at]])
        u[at], seen[at] = np.sqrt(own), 1
        still = open_(at)
        at, own = at[still], own[still]
        home = a[at]
        for g in np.unique(home):
            mine = home == g
            rows, best = at[mine], own[mine]
            reach = np.searchsorted(self.gaps[g], (2 * u[rows] + self.near[g]) * (1 + MARGIN), side="right")
            order = np.argsort(-reach, kind="stable")
            rows, best, reach = rows[order], best[order], reach[order]
            name, second = np.full(len(rows), g), np.full(len(rows), np.inf)
            for j in range(int(reach[0])):
                m = int(np.searchsorted(-reach, -j, side="left"))  # the first m rows reach farther than j
                d, other = _squares(x[rows[:m]], self.c[self.others[g, j]]), self.others[g, j]
                better = (d < best[:m]) | ((d == best[:m]) & (other < name[:m]))
                second[:m] = np.where(better, best[:m], np.minimum(second[:m], d))
                best[:m], name[:m] = np.where(better, d, best[:m]), np.where(better, other, name[:m])
            a[rows], u[rows], low[rows] = name, np.sqrt(best), np.sqrt(second)
            seen[rows] += reach
        return a, u, low, seen


STATE = [T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("computed", T.LongType()), T.StructField("distance", T.LongType())]


def assign(state: DataFrame, c: np.ndarray, moved: np.ndarray, last: bool = False) -> DataFrame:
    """``state`` (vec_id, v, cluster, upper, lower, computed, distance) after one search; distances are filled in by the ``last`` one."""
    balls = state.sparkSession.sparkContext.broadcast(Balls(c, moved))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = balls.value
        for batch in batches:
            rows = max(1, BLOCK // max(1, b.c.shape[1]))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x, (a, u, low, n) = _matrix(part["v"]), (part[f].to_numpy(zero_copy_only=False) for f in ("cluster", "upper", "lower", "computed"))
                a, u, low, seen = b.search(x, a, u, low)
                d = _squares(x, b.c[a]) if last else np.zeros(len(a), np.int64)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(a, pa.int32()), pa.array(u, pa.float64()), pa.array(low, pa.float64()), pa.array(n + seen, pa.int64()), pa.array(d, pa.int64())], names=["vec_id", "v", *[f.name for f in STATE]])

    return state.mapInArrow(work, state.schema)


def sums(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and exact component sums of each cluster: added up within tasks first, so a hot cluster is a row per task."""
    k, d = c.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x, a = _matrix(batch["v"]), batch["cluster"].to_numpy(zero_copy_only=False)
            for g in np.unique(a):
                n[g] += int((a == g).sum())
                s[g] += x[a == g].sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(s[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    part = state.select("cluster", "v").mapInArrow(work, "cluster int, n bigint, sums array<bigint>")
    rows = part.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k * d rows at most
    n, s = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    for r in rows:
        n[r.cluster], s[r.cluster, r.dim] = r.n, r.x
    return n, s


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, computed), centroids) after ``rounds`` of assigning every vector to its nearest centroid and
    replacing each centroid that has members by their floored mean, and one more assignment.

    ``computed`` counts the distances that were taken for a vector; distance is squared.  Every search is written out, so a lost executor
    costs one at most.  What goes to the driver and to all executors are k * d and k * k numbers.
    """
    base = cut(vectors.select("vec_id", "v"), "integers")
    c = seeds(base, k, salt)
    if not len(c):
        return base.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("computed")), c
    inf = F.lit(float("inf"))
    state = base.select("vec_id", "v", F.lit(0).alias("cluster"), inf.alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("computed"), F.lit(0).cast("long").alias("distance"))
    moved = np.zeros(len(c))
    for _ in range(rounds):
        state = cut(assign(state, c, moved), "assigned")
        n, s = sums(state, c)
        new = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c)
        moved = np.sqrt(_squares(new, c)) * (1 + MARGIN)
        c = new
    state = cut(assign(state, c, moved, last=True), "assigned")
    return state.select("vec_id", "cluster", "distance", "computed"), c


def with_inertia(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 (of a centroid's components, joined by commas); a row per cluster is joined."""
    of = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(i, d, sum(of.values()), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, d in sorted(of.items())]
    named = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster")
