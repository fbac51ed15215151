import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import packed
from seqloom.functions.alphabet import RESIDUES, ScoringMatrix
from seqloom.operators import allpairs, clustering, kmers, residues, routing, waves
from seqloom.operators.alignment import global_score, global_score_column, local_score, score_table, with_global, with_local
from seqloom.operators.routing import membership_lines, parse_membership
from seqloom.session import bucketed, cut, open_bucketed, scratch


def slow_global(a, b, m=10, x=-5, g=-5):
    t = [[g * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = max(t[i - 1][j - 1] + (m if a[i - 1] == b[j - 1] else x), t[i - 1][j] + g, t[i][j - 1] + g)
    return t[-1][-1]


def slow_local(a, b, m=10, x=-5, g=-5, e=-2):
    low = -10**9
    v = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        h = low
        for j in range(1, len(b) + 1):
            f[i][j] = max(f[i - 1][j], v[i - 1][j] + g) + e
            h = max(h, v[i][j - 1] + g) + e
            v[i][j] = max(0, v[i - 1][j - 1] + (m if a[i - 1] == b[j - 1] else x), f[i][j], h)
            best = max(best, v[i][j])
    return best


dna = st.text("ACGT", max_size=24)


@settings(max_examples=150, deadline=None)
@given(dna, dna)
def test_scores_equal_plain_tables(a, b):
    assert global_score(a, b) == slow_global(a, b) == global_score(b, a)
    assert local_score(a, b) == slow_local(a, b) == local_score(b, a)


def test_known_scores(spark):
    assert local_score("asdfasdfasdf", "asdfzzzzasdfqiwjkre") == 67
    p = spark.createDataFrame([("asdfasdfasdf", "asdfzzzzasdfqiwjkre"), ("", "")], "seq_a string, seq_b string")
    assert [(r.score, r.distance) for r in with_local(p).collect()] == [(67, 147), (0, 10000)]
    cases = [("ACGT", "AGT", 25), ("AAAA", "CCC", -20), ("GATTACA", "GCATGCT", 20), ("", "A", -5), ("", "", 0)]
    p = spark.createDataFrame([c[:2] for c in cases], "seq_a string, seq_b string")
    rows = with_global(p).withColumn("native", global_score_column(F.col("seq_a"), F.col("seq_b"))).collect()
    assert [r.score for r in rows] == [r.native for r in rows] == [c[2] for c in cases]
    assert (rows[0].distance, rows[0].distance_ref) == (21, 214)


@pytest.mark.parametrize("p", [1, 2, 3, 5, 7])
def test_plane_meets_each_pair_once(spark, p):
    plane = allpairs.Plane(p=p)
    d = allpairs.in_groups(spark.range(plane.n_items).withColumnRenamed("id", "item"), plane).collect()
    groups = {}
    for r in d:
        groups.setdefault(r.grp, []).append(r.item)
    assert len(groups) == plane.n_groups and {len(g) for g in groups.values()} == {p + 1}
    pairs = [tuple(x) for g in groups.values() for x in itertools.combinations(sorted(g), 2)]
    assert len(pairs) == len(set(pairs)) == plane.n_items * (plane.n_items - 1) // 2


def test_plane_order():
    assert [allpairs.plane_order(n) for n in (1, 3, 4, 7, 8, 13, 14, 31, 32, 57, 58)] == [1, 1, 2, 2, 3, 3, 5, 5, 7, 7, 11]
    with pytest.raises(ValueError):
        allpairs.grouper(5, "other")


@pytest.mark.parametrize("strategy", ["plane", "pairs", "auto"])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 8])
def test_all_pairs(spark, strategy, n):
    s = spark.createDataFrame([(i * 10, "A" * i) for i in range(n)], "seq_id bigint, seq string")
    got = sorted((r.id_a, r.id_b) for r in allpairs.all_pairs(s, strategy).collect())
    assert got == [(a * 10, b * 10) for a, b in itertools.combinations(range(n), 2)]


def test_kmer_distance(spark):
    s = spark.createDataFrame([(0, "ABCDEF"), (1, "ABCDEF"), (2, "ABCXYZ"), (3, "GHIJKL"), (4, "AB"), (5, "")], "seq_id bigint, seq string")
    d = {(r.id_a, r.id_b): r.distance for r in allpairs.compare(s, "kmer").collect()}
    assert len(d) == 15 and d[0, 1] == 0 and d[0, 2] == 2459152897 and d[0, 3] == d[0, 4] == d[4, 5] == 5149440885
    assert {r.id_b for r in allpairs.kmer_distance(s, every_pair=False).filter("id_a = 0").collect()} == {1, 2}
    assert allpairs.compare(s, "global").count() == allpairs.compare(s, "local").count() == 15


def test_clustering_equals_plain(spark):
    r = random.Random(5)
    sets = {i: {h for h in range(12) if r.random() < 0.4} for i in range(30)} | {30: set(), 31: {63, 31}}
    v = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "seq_id bigint, h bigint")
    ids = spark.createDataFrame([(i,) for i in sets], "seq_id bigint")
    centers = {k: sets[k] for k in range(4)}
    assigned, got = clustering.cluster(v, ids, 4)
    where = {}
    for step in range(9):
        new = {i: min((len(s ^ c), k) for k, c in centers.items())[::-1] for i, s in sets.items()}
        if new == where:
            break
        where = new
        if step == 8:
            break
        members = {k: [i for i, (c, _) in where.items() if c == k] for k in {c for c, _ in where.values()}}
        centers = {k: {h for h in range(64) if 2 * sum(h in sets[i] for i in m) >= len(m)} for k, m in members.items()}
    assert {x.seq_id: (x.cluster_id, x.distance) for x in assigned.collect()} == where
    one = clustering.medoids(v, assigned)
    for x in one.collect():
        mine = [i for i, (c, _) in where.items() if c == x.cluster_id]
        assert (x.total, x.seq_id) == min((sum(len(sets[i] ^ sets[j]) for j in mine), i) for i in mine)
    assert {x.cluster_id for x in clustering.cluster(v, ids, 3, "medoid", 2)[0].collect()} <= {0, 1, 2}
    union = {(x.cluster_id, x.h) for x in clustering.union_centers(v, assigned).collect()}
    assert union == {(c, h) for i, (c, _) in where.items() for h in sets[i]}
    with pytest.raises(ValueError):
        clustering.seed_centers(v, ids, 99)


def test_routing(spark):
    centers = spark.createDataFrame([(0, 0), (0, 7), (1, 7), (2, 31)], "cluster_id bigint, h bigint")
    q = spark.createDataFrame([(1, "AAAAA"), (2, "RNARNARNA"), (3, "WW"), (4, "XXXXXX")], "query_id bigint, seq string")
    routes = routing.route(q, centers)
    assert {(r.query_id, r.cluster_id): r.n_matches for r in routes.collect()} == {(1, 0): 2, (2, 0): 2, (2, 1): 2}
    assert {(r.query_id, r.n_clusters) for r in routing.count_query_maps(q, routes).collect()} == {(1, 1), (2, 2), (3, 0), (4, 0)}
    assert {(r.cluster_id, r.n_queries) for r in routing.count_cluster_hits(routes).collect()} == {(0, 2), (1, 1)}
    assert routing.route(q, centers, min_fraction=0.9).count() == 1 and routing.route(q, centers, min_matches=3).count() == 0


def test_joins(spark):
    s = spark.createDataFrame([(1, "AAA"), (2, "RNA")], "seq_id bigint, seq string")
    a = spark.createDataFrame([(1, 5), (2, 6)], "seq_id bigint, cluster_id bigint")
    assert {(r.seq_id, r.cluster_id) for r in routing.partition_join(s, a).collect()} == {(1, 5), (2, 6)}
    for bad in (a.union(a), a.filter("seq_id = 1")):
        with pytest.raises(ValueError):
            routing.partition_join(s, bad)
    lines = spark.createDataFrame([("5\t1\t2\t9",), ("6\t2",)], "value string")
    m = routing.parse_membership(lines)
    assert {(r.cluster_id, r.h) for r in routing.cluster_vectors(m, s).collect()} == {(5, 0), (5, 7), (6, 7)}


def test_strict_join(spark):
    """Lazy; every way in which the sides don't match raises when rows are computed, also when only they are counted."""
    s = spark.createDataFrame([(1, "AAA", 0), (2, "RNA", 0)], "seq_id bigint, seq string, cluster_id bigint")
    a = spark.createDataFrame([(1, 5), (2, 6)], "seq_id bigint, cluster_id bigint")
    assert {(r.seq_id, r.seq, r.cluster_id) for r in routing.strict_join(s, a).collect()} == {(1, "AAA", 5), (2, "RNA", 6)}
    assert routing.strict_join(s.limit(0), a.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, 7)], "seq_id bigint, cluster_id bigint")
    for x, y in ((s, a.union(a)), (s, a.filter("seq_id = 1")), (s.filter("seq_id = 1"), a), (s.union(s), a), (s, a.union(nothing))):
        j = routing.strict_join(x, y)
        with pytest.raises(Exception, match="not on both sides exactly once"):
            j.count()


def test_stored_vectors_stay_where_they_are(spark):
    """An iteration shuffles assignments and centers, never vectors; they can be opened again."""
    v = spark.createDataFrame([(i, h) for i in range(40) for h in range(i % 7)], "seq_id bigint, h bigint")
    ids = spark.createDataFrame([(i,) for i in range(40)], "seq_id bigint")
    at = scratch(spark, "kept")
    stored = bucketed(v, "vectors", "seq_id", 4, at)
    counted = bucketed(clustering.sizes(stored, ids, "seq_id"), "sizes", "seq_id", 4)
    centers = cut(clustering.seed_centers(stored, ids, 4), "centers")
    near = clustering.nearest_center(stored, counted.select("seq_id"), F.broadcast(centers), None, counted)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seq_id" not in plan and "Bucketed: true" in plan
    found = bucketed(near, "assignment", "seq_id", 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, clustering.nearest_center(v, ids, centers).collect()))
    update = clustering.kmeans_update(stored, found)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seq_id" not in update
    again = open_bucketed(spark, at, "seq_id bigint, h bigint", "seq_id", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, v.collect()))
    assert "hashpartitioning(seq_id" not in again.groupBy("seq_id").count()._jdf.queryExecution().executedPlan().toString()


def test_seed_samples(spark):
    for n, k in ((16, 16), (1000, 16), (27277, 50), (27277 * 30707, 9)):
        got = clustering.stride_sample(n, k, 3)
        assert len(set(got)) == k and all(0 <= x < n for x in got)
    with pytest.raises(ValueError):
        clustering.stride_sample(3, 4)
    dense = spark.createDataFrame([(i,) for i in range(50)], "seq_id bigint")
    odd = dense.select((7 * F.col("seq_id") + 3).alias("seq_id"))
    want = clustering.stride_sample(50, 5, 2)
    assert [r.seq_id for r in clustering.sampled_ids(dense, 5, 2).orderBy("cluster_id").collect()] == want
    assert [r.seq_id for r in clustering.sampled_ids(odd.union(odd), 5, 2).orderBy("cluster_id").collect()] == [7 * i + 3 for i in want]
    v = dense.select("seq_id", F.col("seq_id").alias("h"))
    assert sorted(r.h for r in clustering.seed_centers(v, dense, 5, "stride", 2).collect()) == sorted(want)
    with pytest.raises(ValueError):
        clustering.seed_centers(v, dense, 5, "other")


def test_packed_vectors(spark):
    r = random.Random(6)
    sets = [sorted(r.sample(range(287), r.randint(1, 200))) for _ in range(12)] + [[0], [63, 64], [286]]
    v = packed.pack(spark.createDataFrame([(i, h) for i, s in enumerate(sets) for h in s + s[:1]], "seq_id bigint, h bigint"), 3, 23)
    assert packed.n_words(3, 23) == 5 and packed.n_words(3, 23, 23) == 191 and dict(v.dtypes)["v"] == packed.TYPE
    a, b = v.select(F.col("seq_id").alias("a"), F.col("v").alias("x")), v.select(F.col("seq_id").alias("b"), F.col("v").alias("y"))
    x, y = F.col("x"), F.col("y")
    for p in a.crossJoin(b).select("a", "b", packed.hashes(x).alias("h"), packed.hashes(packed.union(x, y)).alias("u"), packed.hashes(packed.intersection(x, y)).alias("i"), packed.hamming(x, y).alias("d"), packed.intersects(x, y).alias("m"),
                                   packed.hashes(packed.with_kmer(x, 63)).alias("w"), packed.hashes(packed.with_kmer(x, 63, False)).alias("o"), packed.contains(x, 63).alias("c"), packed.contains(x, 9999).alias("far"), packed.count(packed.empty_like(x)).alias("none")).collect():
        s, t = set(sets[p.a]), set(sets[p.b])
        assert (p.h, p.u, p.i, p.d, p.m) == (sorted(s), sorted(s | t), sorted(s & t), len(s ^ t), bool(s & t))
        assert (p.w, p.o, p.c, p.far, p.none) == (sorted(s | {63}), sorted(s - {63}), 63 in s, False, 0)
    whole = packed.merged(v.select((F.col("seq_id") % 2).alias("g"), "v"), "g").select("g", packed.hashes(F.col("v")).alias("h")).collect()
    assert {x.g: x.h for x in whole} == {g: sorted(set().union(*sets[g::2])) for g in (0, 1)}


@pytest.mark.parametrize("of", [packed.union, packed.intersection, packed.intersection_count, packed.hamming, packed.intersects])
def test_packed_vectors_of_other_parameters(spark, of):
    """Operators of vectors made by another k or alphabet raise; a null gives null."""
    long = spark.createDataFrame([(1, 3)], "seq_id bigint, h bigint")
    v = packed.pack(long, 3, 23).select(F.col("v").alias("x"))
    for k, sigma in ((4, 23), (3, 20)):
        with pytest.raises(Exception, match="different k-mer lengths or alphabets"):
            v.crossJoin(packed.pack(long, k, sigma).select(F.col("v").alias("y"))).select(of(F.col("x"), F.col("y"))).collect()
    with pytest.raises(Exception, match="out of range"):
        packed.pack(spark.createDataFrame([(1, 320)], "seq_id bigint, h bigint"), 3, 23).collect()


def test_hamming_is_a_metric(spark):
    r = random.Random(1)
    sets = {i: {h for h in range(9) if r.random() < 0.5} for i in range(8)}
    v = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s], "a bigint, h bigint")
    common = {(x.a, x.b): x.common for x in kmers.common_hashes(v, v.withColumnRenamed("a", "b")).collect()}
    d = {(i, j): len(sets[i]) + len(sets[j]) - 2 * common.get((i, j), 0) for i in sets for j in sets}
    assert all(d[i, j] == d[j, i] == len(sets[i] ^ sets[j]) and d[i, k] <= d[i, j] + d[j, k] for i, j, k in itertools.product(sets, repeat=3))
    assert math.isclose(sum(d[i, i] for i in sets), 0)


def test_place_over_ranges(spark):
    ids = [7 * i % 101 for i in range(101)]
    rows = allpairs.place(spark.createDataFrame([(i, str(i)) for i in ids], "seq_id long, seq string").repartition(5)).collect()
    assert sorted((r.item, r.seq_id, r.seq) for r in rows) == [(i, i, str(i)) for i in range(101)]


def test_alignment_by_a_matrix():
    """Every score of a matrix is used, in both cases; a matrix of match and mismatch changes nothing."""
    plain = ScoringMatrix({(a, b): 10 if a == b else -5 for a in RESIDUES for b in RESIDUES})
    close = ScoringMatrix({(a, b): 10 if a == b else 7 if {a, b} == {"I", "L"} else -5 for a in RESIDUES for b in RESIDUES})
    for score in (global_score, local_score):
        for a, b in (("ARND", "ARD"), ("", "ILV"), ("BZX", "BZX"), ("é", "A")):
            if not (set(a + b) - set(RESIDUES + "BZX")):
                assert score(a, b, table=score_table(plain)) == score(a, b)
        assert score("ILI", "LIL", table=score_table(close)) == 21 and score("ili", "LIL", table=score_table(close)) == 21


def test_membership_lines(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(50)], "seq_id bigint, cluster_id bigint")
    lines = membership_lines(a, most=5)
    assert lines.count() > 3
    back = parse_membership(lines).collect()
    assert sorted((i, r.cluster_id) for r in back for i in r.members) == [(i, i % 3) for i in range(50)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTé", max_size=20), st.text("ACGTé", max_size=20)), max_size=12), st.booleans())
def test_waves_equal_single_pairs(pairs, by_matrix):
    """Pairs of any lengths in one block, empty ones among them."""
    t = score_table(ScoringMatrix({(x, y): 10 if x == y else 3 if {x, y} <= set("AC") else -5 for x in RESIDUES for y in RESIDUES})) if by_matrix else None
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    usual = waves.PER_WAVE
    for waves.PER_WAVE in (0, usual, 1):  # always waves, as estimated, always rows
        assert waves.scores(a, b, True, 10, -5, -5, -2, t).tolist() == [local_score(x, y, table=t) for x, y in pairs]
        assert waves.scores(a, b, False, 10, -5, -5, table=t).tolist() == [global_score(x, y, table=t) for x, y in pairs]
    waves.PER_WAVE = usual


def test_waves_of_many_and_long_pairs():
    """Several blocks, widths of 16 and 32 bits, and costs that differ from the defaults."""
    r = random.Random(8)
    some = lambda n: "".join(r.choice("ARND") for _ in range(n))
    pairs = [(some(r.randint(0, 90)), some(r.randint(0, 90))) for _ in range(700)] + [(some(1900), some(2100)), (some(3), some(5000)), ("A" * 1500, "A" * 1500)] + [(some(120), some(1000 + i)) for i in range(30)]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for costs in ({}, {"match": 3, "mismatch": -1, "gap": -4}):
        full = {"match": 10, "mismatch": -5, "gap": -5} | costs
        assert waves.scores(a, b, False, **full).tolist() == [global_score(x, y, **full) for x, y in pairs]
        assert waves.scores(a, b, True, **full, extend=-2).tolist() == [local_score(x, y, **full) for x, y in pairs]


def test_lengths_and_nulls(spark):
    p = spark.createDataFrame([("ACGT", "AC"), (None, "A"), ("", "")], "seq_a string, seq_b string")
    assert [(r.score, r.max_length) for r in with_local(p).collect()] == [(20, 2), (0, 0), (0, 0)]
    assert [(r.score, r.max_length) for r in with_global(p).collect()] == [(10, 2), (-5, 0), (0, 0)]


def near_matrix():
    return ScoringMatrix({(x, y): 10 if x == y else 4 if {x, y} in ({"I", "L"}, {"D", "E"}) else -5 for x in RESIDUES for y in RESIDUES})


@pytest.mark.parametrize("threshold", [-100, 5, 15, 24, 30, 31])
def test_neighbours_equal_all_kmers(spark, threshold):
    m, asked = near_matrix(), ["ILD", "AAA", "aei", "AXA", "AA", None, "ILD", "***"]
    of = lambda a, b: sum(m.score(x, y) for x, y in zip(a, b))
    every = ["".join(t) for t in itertools.product(RESIDUES, repeat=3)] if threshold > -100 else []
    got = kmers.neighbours(spark.createDataFrame([(x,) for x in asked], "kmer string"), m, threshold, 3)
    if threshold == -100:  # nothing is out of reach
        assert got.groupBy("kmer").count().collect() and {r["count"] for r in got.groupBy("kmer").count().collect()} == {len(RESIDUES) ** 3}
    else:
        assert sorted((r.kmer, r.neighbour, r.score) for r in got.collect()) == sorted((a, b, of(a, b)) for a in ("ILD", "AAA", "aei", "***") for b in every if of(a, b) >= threshold)


def test_routing_by_neighbours(spark):
    """Equal k-mers only at the highest threshold, which is route(); below it, near ones, and each occurrence once."""
    base = len(RESIDUES)
    s = spark.createDataFrame([(0, "ILDILD"), (1, "LLE"), (2, "AAAA")], "seq_id bigint, seq string")
    centers = kmers.presence(s, 3, 1, base).withColumnRenamed("seq_id", "cluster_id")
    q = spark.createDataFrame([(7, "ILDILDW"), (8, "AAAX"), (9, "W")], "query_id bigint, seq string")
    rows = lambda d: sorted(map(tuple, d.select("query_id", "cluster_id", "n_matches").collect()))
    assert rows(routing.route_by_neighbours(q, centers, near_matrix(), 30, base=base)) == rows(routing.route(q, centers, base=base)) == [(7, 0, 4), (8, 2, 1)]
    assert rows(routing.route_by_neighbours(q, centers, near_matrix(), 18, base=base)) == [(7, 0, 4), (7, 1, 2), (8, 2, 1)]
    assert rows(routing.route_by_neighbours(q, centers, near_matrix(), 18, base=base, min_fraction=0.9)) == [(7, 0, 4), (8, 2, 1)]


def _broadcast_scans(df):
    """Folders whose rows a broadcast of ``df``'s plan reads row by row, without counting them first."""
    lines, found = df._jdf.queryExecution().sparkPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line:
            left = next(j for j in range(i + 1, len(lines)))
            right = next(j for j in range(left + 1, len(lines)) if depth(lines[j]) == depth(lines[left]))
            begin, end = (left, right) if "BuildLeft" in line else (right, next((j for j in range(right + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines)))
            if not any("Aggregate" in x for x in lines[begin:end]):
                found += [x for x in lines[begin:end] if "FileScan" in x]
    return found


def test_medoids_dont_send_vectors_through_the_driver(spark):
    from seqloom.session import bucketed

    v = bucketed(spark.range(4000).selectExpr("id div 10 as seq_id", "id % 10 as h"), "probe", "seq_id")
    a = bucketed(spark.range(400).selectExpr("id as seq_id", "id % 4 as cluster_id"), "probe", "seq_id")
    df = clustering.kmedoid_update(v, a)
    assert not [x for x in _broadcast_scans(df) if "[seq_id#" in x and ",h#" in x]
    assert sorted(map(tuple, df.collect())) == [(c, h) for c in range(4) for h in range(10)]


def test_groups_of_pairs_dont_go_through_the_driver(spark):
    df = allpairs.all_pairs(spark.range(60).selectExpr("id as seq_id", "'' as seq"), "plane")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [grp" in plan and "BroadcastHashJoin [grp" not in plan
    assert df.count() == df.select("id_a", "id_b").distinct().count() == 60 * 59 // 2


@pytest.mark.parametrize("design", [*(allpairs.Plane(p=p) for p in (1, 2, 3, 5, 7)), allpairs.PairSplit(9)])
def test_members_are_the_inverse_of_groups(spark, design):
    d = spark.range(design.n_items).select("id", design.groups(F.col("id")).alias("groups")).collect()
    held, members = {}, design.members()
    for r in d:
        for g in r.groups:
            held.setdefault(g, []).append(r.id)
    for r in d:
        got = members(np.array(r.groups), r.id).tolist()
        want = [i for g in r.groups for i in held[g]]
        assert sorted(x for x in got if x > r.id) == sorted(x for x in want if x > r.id) and not set(got) - set(want)


@pytest.mark.parametrize("strategy", ["plane", "pairs"])
def test_coverage_makes_no_rows_of_pairs(spark, strategy):
    """As all_pairs() gives it; what is shuffled doesn't grow with the pairs, and a design that repeats or lacks pairs shows."""
    s = spark.range(60).selectExpr("id * 3 as seq_id", "'' as seq").repartition(5)
    p = allpairs.all_pairs(s, strategy).groupBy("id_a").agg(F.count("*"), F.countDistinct("id_b"))
    df = allpairs.coverage(s, strategy)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, p.collect())) == [(3 * i, 59 - i, 59 - i) for i in range(59)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join [grp" not in plan and "explode" not in plan

    class Wrong(allpairs.Plane):
        def groups(self, item):
            g = super().groups(item)
            return F.when(item == 0, F.concat(g, F.slice(g, 1, 1))).when(item == 1, F.slice(g, 1, 1)).otherwise(g)

    got = {r.seq_id: (r.n, r.others) for r in allpairs.coverage(s, design=Wrong(60)).collect()}
    assert got[0] == (59 + Wrong(60).p - 1, 59) and got[3] == (Wrong(60).p - 2,) * 2 and got[6] == (57, 57)
    repeated = spark.createDataFrame([(5,), (5,), (None,), (7,), (8,)], "seq_id bigint")
    assert sorted(map(tuple, allpairs.coverage(repeated, strategy).collect())) == [(5, 4, 4), (7, 1, 1)]


def test_centers_are_sent_to_the_vectors(spark):
    v = spark.range(4000).selectExpr("id div 10 as seq_id", "id % 10 as h")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if Spark took the centers for large
    try:
        near = clustering.nearest_center(v, v.select("seq_id").distinct(), v.filter("seq_id < 3").withColumnRenamed("seq_id", "cluster_id"))
        assert "BroadcastHashJoin [h#" in near._jdf.queryExecution().sparkPlan().toString()
        assert {tuple(r)[1:] for r in near.collect()} == {(0, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_mean_iterations_send_centers_to_rows_of_vectors(spark, monkeypatch):
    """Neither the vectors nor an assignment are dealt out; the join, which takes over where centers are many, gives the same, with empty, repeated and null ids."""
    r = random.Random(8)
    seqs = [(i, "".join(r.choice("ARND") for _ in range(r.randint(0, 40)))) for i in range(60)]
    s = spark.createDataFrame([*seqs, (61, None), (62, "XX"), (7, "WWWWWW"), (None, "ARNARN")], "seq_id bigint, seq string").repartition(3)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    v = kmers.presence_rows(s)
    assert rows(kmers.unpacked(v)) == rows(kmers.presence(s)) and rows(v.select("seq_id")) == rows(s.select("seq_id").distinct())
    plain = spark.createDataFrame(seqs, "seq_id bigint, seq string")
    assert "Aggregate" not in kmers.presence_rows(plain)._jdf.queryExecution().sparkPlan().toString()
    want = {}
    for name, cells in (("join", 0), ("sent", clustering.CELLS)):
        monkeypatch.setattr(clustering, "CELLS", cells)
        if name == "sent":
            monkeypatch.setattr(clustering, "bucketed", None)
        want[name] = [rows(x) for x in clustering.cluster(v, s, 4, max_iter=3)]
    assert want["join"] == want["sent"] and len(want["sent"][0]) == 63 and len(want["sent"][1]) > 10
    assert want["sent"] == [rows(x) for x in clustering.cluster(kmers.presence(s), s, 4, max_iter=3)]


def test_sent_centers(spark):
    """Nearest by lookup and by search, ties to the lowest id, empty vectors and centers, hashes far apart; tallies in several parts."""
    r = random.Random(9)
    for far in (1, 1 << 40):
        sets = [{far * h for h in range(20) if r.random() < 0.3} for _ in range(50)] + [set(), {far * 99, -3}]
        centers = {3: sets[0], 5: sets[1], 9: set(), 11: sets[0]}
        rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "seq_id bigint, hashes array<bigint>").repartition(2)
        c = spark.createDataFrame([(i, h) for i, x in centers.items() for h in x], "cluster_id bigint, h bigint")
        few = clustering.sent(c, spark.createDataFrame([(i,) for i in centers], "cluster_id bigint"))
        want = {i: min((len(x ^ y), k) for k, y in centers.items())[::-1] for i, x in enumerate(sets)}
        found = clustering.assigned(rows, few)
        assert {x.seq_id: (x.cluster_id, x.distance) for x in found.collect()} == want
        counts = {}
        for i, x in enumerate(sets):
            for h in [None, *x]:
                counts[want[i][0], h] = counts.get((want[i][0], h), 0) + 1
        assert {(x.cluster_id, x.h): x.n for x in clustering.tallies(rows, few).collect()} == counts
    held = [(np.array([1, 0]), np.array([4, 4]), np.array([2, 3])), (np.array([0, 1]), np.array([4, 5]), np.array([1, 1]))]
    assert [x.tolist() for x in residues.added(held)] == [[0, 1, 1], [4, 4, 5], [4, 2, 1]] and [len(x) for x in residues.added([])] == [0, 0, 0]
