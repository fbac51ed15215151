"""Hamming K-means and K-medoid clustering of presence vectors in long form (seq_id, h).

Distances are never taken pair by pair: |a xor c| = |a| + |c| - 2 |a and c|, and intersections are counted by a
join on the hash.  A vector that shares nothing with a center is at |a| + |c|, so the smallest center stands for all
those.  A member's total distance to its cluster is linear in its hashes: with m members and cnt(h) of them having h,
it is m |a| + sum of sizes - 2 * sum of cnt(h) over a's hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, cut
from . import residues
from .allpairs import place
from .kmers import long_form, schemas, unpacked

#: Prime strides of the seed sample.
STRIDES = (27277, 30707)


def sizes(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, n) for every id in ``ids``, 0 for empty vectors."""
    return ids.select(key).join(vectors.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def stride_sample(n: int, k: int, seed: int = 0) -> list[int]:
    """``k`` distinct numbers below ``n``: seed, seed + p, seed + 2 p, ... modulo n, by a prime stride p that doesn't divide n."""
    if k > n:
        raise ValueError(f"{k} clusters of {n} sequences")
    fits = (p for p in (*STRIDES, *range(STRIDES[-1] + 2, STRIDES[-1] + 2000, 2)) if n % p and all(p % d for d in range(3, int(p**0.5) + 1, 2)))
    p = next(fits)
    return [(seed + i * p) % n for i in range(k)]


def sampled_ids(ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cluster_id, seq_id) of a stride_sample() of the distinct ids by their places in order.

    Ids that count from 0 without gaps, as number_sequences() gives them, are their own places: no id is sorted or moved.  Others are
    ranked within ranges first."""
    spark = ids.sparkSession
    own = ids.select("seq_id").distinct()
    s = own.agg(F.count("*").alias("n"), F.min("seq_id").alias("low"), F.max("seq_id").alias("high")).first()
    chosen = spark.createDataFrame(list(enumerate(stride_sample(s.n, k, seed))), "cluster_id bigint, seq_id bigint")
    if s.low == 0 and s.high == s.n - 1:
        return chosen
    return place(own).join(F.broadcast(chosen.withColumnRenamed("seq_id", "item")), "item").select("cluster_id", "seq_id")  # k rows


def seed_centers(vectors: DataFrame, ids: DataFrame, k: int, sample: str = "first", seed: int = 0) -> DataFrame:
    """(cluster_id, h): the vectors of the first ``k`` ids or, by sample ``stride``, of sampled_ids(); cluster ids count from 0.
    Raises if there are fewer ids."""
    if sample not in ("first", "stride"):
        raise ValueError(f"unknown sample {sample!r}")
    if sample == "stride":
        return long_form(vectors.join(F.broadcast(sampled_ids(ids, k, seed)), "seq_id"), "cluster_id")  # k rows
    first = [r.seq_id for r in ids.select("seq_id").distinct().orderBy("seq_id").limit(k).collect()]
    if len(first) < k:
        raise ValueError(f"{k} clusters of {len(first)} sequences")
    named = ids.sparkSession.createDataFrame(list(enumerate(first)), "cluster_id bigint, seq_id bigint")
    return long_form(vectors.join(F.broadcast(named), "seq_id"), "cluster_id")


#: Rows of centers up to which every iteration's centers are sent to all executors: two numbers a row, 16 MB.
BROADCAST_ROWS = 1_000_000

#: Cells of the table of centers by hashes that a task may hold (32 MB), hashes of vectors it takes at once, and numbers it looks up hashes by (8 bytes each).
CELLS, HASHES, TABLE = 1 << 22, 1 << 20, 1 << 18


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count says that it is small; otherwise marked against it, as Spark guesses from the sizes of compressed files."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _with_cluster(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """``vectors`` with cluster_id.  Only a partition's assignments are held in memory, and neither side goes through the driver, however small its files."""
    return vectors.join(assignment.select("seq_id", "cluster_id").hint("shuffle_hash"), "seq_id")


def nearest_center(vectors: DataFrame, ids: DataFrame, centers: DataFrame, center_ids: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(seq_id, cluster_id, distance): the center at least Hamming distance, the lowest id among equals.  ``counted`` are the
    vectors' sizes (seq_id, n), if known.  Centers are counted and, up to BROADCAST_ROWS, sent to the vectors, which then aren't dealt out by hash:
    a hash that most vectors have would gather most of them in one task."""
    center_ids = centers.select("cluster_id").distinct() if center_ids is None else center_ids
    centers = small(centers)
    c = sizes(centers, center_ids, "cluster_id").withColumnRenamed("n", "n_c")
    v = (sizes(vectors, ids, "seq_id") if counted is None else counted).withColumnRenamed("n", "n_v")
    meet = vectors.join(centers, "h").groupBy("seq_id", "cluster_id").agg(F.count("*").alias("common"))
    near = meet.join(v, "seq_id").join(c, "cluster_id").select("seq_id", F.struct((F.col("n_v") + F.col("n_c") - 2 * F.col("common")).alias("distance"), "cluster_id").alias("b"))
    least = c.agg(F.min(F.struct(F.col("n_c"), F.col("cluster_id"))).alias("l"))  # one row
    far = F.struct((F.col("n_v") + F.col("l.n_c")).alias("distance"), F.col("l.cluster_id").alias("cluster_id"))
    best = v.join(near.groupBy("seq_id").agg(F.min("b").alias("near")), "seq_id", "left").crossJoin(F.broadcast(least))
    return best.select("seq_id", F.least("near", far).alias("b")).select("seq_id", "b.cluster_id", "b.distance")


def kmeans_update(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, h): hashes that at least half of a cluster's members have."""
    members = assignment.groupBy("cluster_id").agg(F.count("*").alias("n"))
    held = _with_cluster(vectors, assignment).groupBy("cluster_id", "h").agg(F.count("*").alias("cnt"))
    return held.join(members, "cluster_id").filter(2 * F.col("cnt") >= F.col("n")).select("cluster_id", "h")


def medoids(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, seq_id, total): the member with the least summed Hamming distance to its cluster, the lowest id among equals."""
    a = assignment.select("seq_id", "cluster_id")
    named = _with_cluster(vectors, a)
    held = cut(named.groupBy("cluster_id", "h").agg(F.count("*").alias("cnt")), "held")
    whole = a.groupBy("cluster_id").agg(F.count("*").alias("m")).join(held.groupBy("cluster_id").agg(F.sum("cnt").alias("all_n")), "cluster_id", "left")
    own = named.join(small(held), ["cluster_id", "h"]).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("cnt").alias("common"))
    none = lambda c: F.coalesce(c, F.lit(0))
    t = a.join(own, "seq_id", "left").join(small(cut(whole, "whole")), "cluster_id")
    t = t.withColumn("total", F.col("m") * none("n") + none("all_n") - 2 * none("common"))
    best = t.groupBy("cluster_id").agg(F.min(F.struct("total", "seq_id")).alias("b"))
    return best.select("cluster_id", "b.seq_id", "b.total")


def kmedoid_update(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, h): the medoids' vectors."""
    chosen = small(cut(medoids(vectors, assignment).select("cluster_id", "seq_id"), "medoids"))  # a row per cluster
    return vectors.join(chosen, "seq_id").select("cluster_id", "h")


def union_centers(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, h): every hash that a member has.  ``vectors`` are in long form or in rows (seq_id, hashes), which are opened after they have met their clusters."""
    return long_form(_with_cluster(vectors, assignment), "cluster_id").distinct()


class Sent(NamedTuple):
    """Centers as every task has them: cluster ids in order, those of empty centers too, their distinct hashes, and how often each center has each one
    (the last column, of zeros, is for other hashes)."""

    names: np.ndarray
    hashes: np.ndarray
    held: np.ndarray

    def same(self, other: Sent) -> bool:
        return all(np.array_equal(x, y) for x, y in zip(self, other))

    def nearest(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest center, distance) of the vectors whose hashes are ``h`` between ``bounds``."""
        at = np.searchsorted(self.hashes, h) if len(self.hashes) == 0 or self.hashes[-1] - self.hashes[0] >= TABLE else self._looked_up(h)
        if len(self.hashes):
            at = np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h, at, len(self.hashes))
        n = np.diff(bounds)
        some = n > 0
        which, least = np.zeros(len(n), np.int64), np.full(len(n), np.iinfo(np.int64).max)
        for c, held in enumerate(self.held):
            distance = n + int(held.sum())
            if len(h):
                distance[some] -= 2 * np.add.reduceat(held[at], bounds[:-1][some])
            which[distance < least] = c
            np.minimum(least, distance, out=least)
        return which, least

    def _looked_up(self, h: np.ndarray) -> np.ndarray:
        low, n = self.hashes[0], self.hashes[-1] - self.hashes[0] + 1
        table = np.searchsorted(self.hashes, np.arange(low, low + n))
        return table[np.clip(h - low, 0, n - 1)]


def sent(centers: DataFrame, names: DataFrame) -> Sent | None:
    """The centers if they are few enough to be sent to all tasks (BROADCAST_ROWS) and their table is small and not mostly empty; they are counted first."""
    rows = centers.count()
    if rows > BROADCAST_ROWS:
        return None
    c, h = (x.to_numpy() for x in centers.select(F.col("cluster_id").cast("bigint"), F.col("h").cast("bigint")).toArrow().columns)
    ids, hashes = np.unique(names.select(F.col("cluster_id").cast("bigint")).toArrow().column(0).to_numpy()), np.unique(h)
    if not len(ids) or len(ids) * (len(hashes) + 1) > min(CELLS, 64 * (rows + len(ids) + len(hashes) + 1)):
        return None
    known = np.isin(c, ids)
    held = np.zeros((len(ids), len(hashes) + 1), np.int64)
    np.add.at(held, (np.searchsorted(ids, c[known]), np.searchsorted(hashes, h[known])), 1)
    return Sent(ids, hashes, held)


def vector_rows(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(seq_id, hashes): a row for every id in ``ids``, whose vector in ``vectors`` (long form) may be empty."""
    v = vectors.groupBy("seq_id").agg(F.collect_list(F.col("h").cast("bigint")).alias("hashes"))
    return ids.select("seq_id").distinct().join(v, "seq_id", "left").select("seq_id", F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(seq_id, hashes, their bounds by row) of vectors in rows, some HASHES at a time."""
    for b in batches:
        v = b.column(1)
        ends, at = np.asarray(v.offsets)[1:].astype(np.int64) - v.offsets[0].as_py(), 0
        flat = v.flatten().to_numpy()
        while at < len(v):
            start = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, start + HASHES, "right")), at + 1)
            yield b.column(0).slice(at, to - at), flat[start : ends[to - 1]], np.append(0, ends[at:to] - start)
            at = to


def assigned(rows: DataFrame, centers: Sent) -> DataFrame:
    """nearest_center() of vectors in rows (seq_id, hashes), where they are: nothing is shuffled."""
    schema, arrow = schemas(rows, ("seq_id",), "cluster_id bigint, distance bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, bounds in _lists(batches):
            which, distance = centers.nearest(h, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(centers.names[which]), pa.array(distance)], schema=arrow)

    return rows.mapInArrow(work, schema)


def tallies(rows: DataFrame, centers: Sent) -> DataFrame:
    """(cluster_id, h, n): how many vectors of the rows nearest to each center have each hash and, where h is null, how many there are.  Tasks add up their own
    vectors' first; only sums are shuffled."""
    schema, arrow = schemas(rows, (), "cluster_id bigint, h bigint, n bigint")

    def batch(c: np.ndarray, h: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(centers.names[c]), h, pa.array(n)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members = [], np.zeros(len(centers.names), np.int64)
        for _, h, bounds in _lists(batches):
            which, _ = centers.nearest(h, bounds)
            members += np.bincount(which, minlength=len(members))
            held.append(residues.counted(np.repeat(which, np.diff(bounds)), h))
            if sum(len(x) for x, _, _ in held) >= 2 * residues.HELD:
                held = [residues.added(held)]
                if len(held[0][0]) >= residues.HELD:
                    c, h, n = held.pop()
                    yield batch(c, pa.array(h), n)
        c, h, n = residues.added(held)
        yield batch(c, pa.array(h), n)
        c = np.flatnonzero(members)
        yield batch(c, pa.nulls(len(c), pa.int64()), members[c])

    return rows.mapInArrow(work, schema).groupBy("cluster_id", "h").agg(F.sum("n").alias("n"))


def cluster(vectors: DataFrame, ids: DataFrame, k: int, update: str = "mean", max_iter: int = 8, centers: DataFrame | None = None, sample: str = "first", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(assignment, centers) after at most ``max_iter`` updates, or as soon as no center changes.  ``vectors`` are in long form, or in rows (seq_id, hashes), one for
    each id in ``ids``, as kmers.presence_rows() gives them, which the caller has stored, as every iteration reads them.

    A cluster without members goes; one whose center becomes empty stays as long as it has members.  Vectors are stored in rows, and centers are sent to them: a mean
    iteration reads the rows once and shuffles sums only.  Centers that are too many for that, and medoids, are joined with the long form, stored in buckets of seq_id like
    sizes and assignments, so that no iteration shuffles the vectors.  Centers of every iteration are written out, so a lost executor costs one iteration at most.
    """
    none = F.array().cast("array<bigint>")
    rows = vectors if "hashes" in vectors.columns else cut(vector_rows(vectors, ids), "rows")
    rows = rows.select("seq_id", F.when(F.col("seq_id").isNotNull(), F.col("hashes")).otherwise(none).alias("hashes"))
    ids = rows.select("seq_id")

    @functools.cache
    def joined() -> tuple[DataFrame, DataFrame]:
        return bucketed(unpacked(rows), "vectors", "seq_id"), bucketed(rows.select("seq_id", F.size("hashes").cast("bigint").alias("n")), "sizes", "seq_id")

    def near(centers: DataFrame, names: DataFrame, few: Sent | None) -> DataFrame:
        return assigned(rows, few) if few else nearest_center(joined()[0], ids, centers, names, joined()[1])

    def moved(centers: DataFrame, names: DataFrame, few: Sent | None) -> tuple[DataFrame, DataFrame]:
        """The next centers and the clusters that have members."""
        if update == "mean" and few:
            t = cut(tallies(rows, few), "tallies")
            members = t.filter("h IS NULL").select("cluster_id", F.col("n").alias("m"))
            return t.filter("h IS NOT NULL").join(members, "cluster_id").filter("2 * n >= m").select("cluster_id", "h"), members.select("cluster_id")
        assignment = bucketed(near(centers, names, few), "assignment", "seq_id")
        return step(joined()[0], assignment), assignment.select("cluster_id").distinct()

    step = {"mean": kmeans_update, "medoid": kmedoid_update}[update]
    centers = cut(seed_centers(rows, ids, k, sample, seed) if centers is None else centers, "centers")
    names = centers.select("cluster_id").distinct()
    few = sent(centers, names)
    for _ in range(max_iter):
        new, names_of_new = (cut(x, "centers") for x in moved(centers, names, few))
        few_of_new = sent(new, names_of_new)
        if few and few_of_new:
            stays = few.same(few_of_new)
        else:
            stays = all(a.exceptAll(b).isEmpty() for x, y in ((centers, new), (names, names_of_new)) for a, b in ((x, y), (y, x)))
        if stays:
            break
        centers, names, few = new, names_of_new, few_of_new
    return cut(near(centers, names, few), "assignment"), centers
