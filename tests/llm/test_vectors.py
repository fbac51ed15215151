import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import kmeans, whiten

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, x int"


def odd_rows(dim=64, n=60):
    """Vectors with nulls, non-finite entries, other lengths, repeated rows and ids, ties and a null id."""
    r = random.Random(3)
    some = lambda: [r.choice([-1.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(dim)]
    rows = [(i, some()) for i in range(n)]
    rows += [rows[0], rows[0], (5, some()), (None, some()), (900, rows[1][1])]
    rows += [(901, None), (902, []), (903, [1.0]), (904, [None, *some()[1:]]), (905, [math.nan, *some()[1:]]), (906, [math.inf, *some()[1:]]), (907, some() + [0.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def whole(v, dim=64):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def plain_kmeans(rows, k, rounds):
    v = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if whole(v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x for _, x in sorted(v, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        where = [nearest(x)[1] for _, x in v]
        c = [[sum(col) // len(col) for col in zip(*(x for (_, x), w in zip(v, where) if w == j))] if j in where else y for j, y in enumerate(c)]
    return [(i, *nearest(x)[::-1]) for i, x in v], c


@pytest.mark.parametrize("k", [1, 2, 7, 16, 500])
def test_clusters_equal_plain_search(spark, k):
    rows = odd_rows()
    got, c = kmeans.cluster(kmeans.integer_vectors(frame(spark, rows)), k=k)
    want, centroids = plain_kmeans(rows, k, 3)
    key = lambda x: str(tuple(x))
    assert sorted(map(key, got.select("vec_id", "cluster", "distance").collect())) == sorted(map(key, want)) and c.tolist() == centroids
    total = kmeans.with_inertia(got, c).select("cluster", "cluster_inertia", "inertia", "centroid_sha256").distinct().collect()
    for r in total:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_search_looks_at_few_and_keeps_ties(spark):
    """Far apart groups: bounds save most distances.  A vector halfway between two centroids goes to the smaller number."""
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(50 * (i % 16), 1, 4)]) for i in range(1600)]
    got, _ = kmeans.cluster(kmeans.integer_vectors(frame(spark, rows), dim=4))
    assert got.agg(F.sum("computed")).first()[0] < 1600 * 16 * 4 / 3
    b = kmeans.Balls(np.array([[0, 0], [4, 0], [0, 4], [4, 4]]), np.zeros(4))
    x = np.array([[2, 0], [2, 2], [4, 2], [4, 4]])
    for start in range(4):
        assert b.search(x, np.full(4, start), np.full(4, np.inf), np.zeros(4))[0].tolist() == [0, 0, 1, 3]


def test_clusters_of_nothing(spark):
    got, c = kmeans.cluster(kmeans.integer_vectors(frame(spark, [(1, None), (2, [1.0])])))
    assert kmeans.with_inertia(got, c).collect() == [] and len(c) == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.integer_vectors(frame(spark, [(1, [1e30] * 64)])).collect()


def test_whitening_equals_plain(spark):
    rows = odd_rows()
    got, w = whiten.whiten(whiten.integer_vectors(frame(spark, rows)))
    kept = [(i, [math.floor(1024 * x) + 100000 for x in v]) for i, v in rows if whole(v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    deviation = ((n * x - s) ** 2).sum(axis=1)
    out = got.collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n} and all(r.identity_error < 1e-9 for r in out)
    of = {}
    for r in out:
        of.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    for (i, v), d in zip(kept, deviation):
        for k in range(1, 9):
            y = (np.array(v) - s / n) @ vectors[:, -k] / math.sqrt(values[-k])
            r = of[i, int(d)][k][0]
            assert min(abs(r.whitened - y), abs(r.whitened + y)) < 1e-6 and r.explained == pytest.approx(values[-k] / values.sum(), rel=1e-9)
    for k in range(8):  # a direction has one sign in all rows
        y = (x - s / n) @ vectors[:, -k - 1]
        assert len({bool(of[i, int(d)][k + 1][0].whitened > 0) == bool(p > 0) for (i, _), d, p in zip(kept, deviation, y) if abs(p) > 1e-6}) == 1
    assert w.sums.tolist() == s.tolist()


def test_whitening_of_few_and_none(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(9, [1.0, 2.0])]
    out = whiten.whiten(whiten.integer_vectors(frame(spark, line)))[0].collect()
    assert len(out) == 9 and {r.component for r in out} == {1} and all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in out)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        assert whiten.whiten(whiten.integer_vectors(frame(spark, rows)))[0].collect() == []
    with pytest.raises(Exception, match="too large"):
        whiten.integer_vectors(frame(spark, [(1, [3e38])])).collect()


def test_projection_of_many_tasks(spark):
    """Merging in a tree gives what one task gives."""
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(0, 1, 5)]) for i in range(200)]
    one, many = (whiten.fit(whiten.integer_vectors(frame(spark, rows).repartition(p))) for p in (1, 9))
    assert np.allclose(one.values, many.values) and np.allclose(one.vectors, many.vectors)
    parts = whiten.integer_vectors(frame(spark, rows).repartition(9))
    assert whiten.identity_error(parts, many) < 1e-9
    doubled = whiten.Whitening(many.n, many.sums, many.values * 4, many.vectors, many.trace)
    assert whiten.identity_error(parts, doubled) == pytest.approx(0.75)
