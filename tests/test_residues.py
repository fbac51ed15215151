"""K-mers and frames of blocks of rows equal those of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.functions.alphabet import RESIDUES
from seqloom.operators import kmers, residues

ODD = [None, "", "A", "AC", "ACD", "acdEFG", "AXCDEF", "AB\nCDEFGH", "ABCD\nEFGHI", "ABé" + "CDEFGHIK", "AR字NDCEQGH", "ıACD", "Aß CDE", "*UO*UO-", "ACD EFGHIK", "ACDEFGHIKL"]


@pytest.fixture(scope="module")
def seqs(spark):
    r = random.Random(4)
    texts = ODD + ["".join(r.choices(RESIDUES + "BZacgt", k=r.randint(0, 90))) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string").repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k,stride,last,base", [(3, 1, False, None), (3, 3, False, None), (3, 3, True, None), (5, 1, True, 23), (5, 2, False, 23), (2, 3, True, 23)])
def test_hashes_equal_column_functions(spark, seqs, k, stride, last, base):
    km = seqs.select("seq_id", F.explode(S.kmers(F.col("seq"), k, stride, last)).alias("km")).select("seq_id", S.kmer_hash(F.col("km"), k, base).alias("h"))
    want = km.filter("h is not null").cache()
    assert rows(kmers.hashed_kmers(seqs, k, stride, last, base)) == rows(want)
    assert rows(kmers.counted_kmers(seqs, k, stride, last, base)) == rows(want.groupBy("seq_id", "h").count())
    assert rows(kmers.counted_kmers(seqs, k, stride, last, base, keep=()).groupBy("h").agg(F.sum("n"))) == rows(want.groupBy("h").count())
    arrays = seqs.select("seq_id", F.transform(S.kmers(F.col("seq"), k, stride, last), lambda x: S.kmer_hash(x, k, base)).alias("v"))
    assert rows(kmers.hash_arrays(seqs, k, stride, last, base)) == rows(arrays)


def test_class_hashes(spark, seqs):
    s = kmers.compressed(seqs, missing="drop")
    want = s.select(F.explode(S.kmers(F.col("seq"), 3)).alias("km")).select(S.compressed_kmer_hash(F.col("km"), 3).alias("h")).groupBy("h").count()
    assert rows(kmers.counted_kmers(s, 3, keep=(), letters="class").groupBy("h").agg(F.sum("n"))) == rows(want)


@pytest.mark.parametrize("last", [False, True])
def test_frames_equal_column_functions(spark, seqs, last):
    s = seqs.union(seqs.select(F.col("seq_id") + 1000, S.as_dna(F.upper("seq")))).union(spark.createDataFrame([(5000, "T,TTTTGGG"), (5001, "ACTTGACA")], "a bigint, b string"))
    want = s.select((6 * F.col("seq_id")).alias("i"), F.posexplode(S.six_frames(F.col("seq"), last)).alias("f", "s")).select(F.expr("i + f"), F.expr("i div 6"), F.col("f").cast("bigint"), "s")
    assert rows(kmers.translate(s, last)) == rows(want)


def test_blocks_cover_all_rows_by_letters():
    import pyarrow as pa

    b = pa.record_batch({"i": range(6), "s": ["a" * 600_000, None, "b" * 600_000, "c" * 3_000_000, "", "d"]})
    assert [x.column(0).to_pylist() for x in residues.blocks([b])] == [[0, 1], [2], [3], [4, 5]]


def test_tables_of_counts():
    import numpy as np

    h, n = residues.summed([(np.array([3, 1, 3]), np.array([1, 2, 4])), (np.array([1, 9]), np.array([5, 6]))])
    assert h.tolist() == [1, 3, 9] and n.tolist() == [7, 5, 6]
    assert [x.tolist() for x in residues.counted(np.array([0, 0, 2, 2]), np.array([-5, -5, 7, -5]))] == [[0, 2, 2], [-5, -5, 7], [2, 1, 1]]


def test_any_characters(spark, seqs):
    found = seqs.select("seq_id", F.explode(F.regexp_extract_all("seq", F.lit("(?s)(?=(.{4}))"), F.lit(1))).alias("km")).groupBy("seq_id", "km").count()
    assert sorted((r.seq_id, r.n) for r in kmers.counted_any(seqs, 4, "seq_id").collect()) == sorted((r.seq_id, r["count"]) for r in found.collect())
    assert kmers.counted_any(seqs, 4).select("h").distinct().count() == found.select("km").distinct().count()


def test_presence_in_place_shuffles_repeated_ids_only(spark, seqs):
    once = kmers.presence_in_place(seqs, 3, 1, 23)
    assert "HashAggregate" not in once._jdf.queryExecution().sparkPlan().toString()
    assert rows(once) == rows(kmers.presence(seqs, 3, 1, 23))
    twice = seqs.union(seqs.limit(40))
    assert rows(kmers.presence_in_place(twice, 3, 1, 23)) == rows(kmers.presence(twice, 3, 1, 23)) == rows(once)


def test_bounds_are_the_same_by_sent_queries_and_by_clusters(spark, seqs, monkeypatch):
    from seqloom.operators import search

    q = seqs.filter("seq_id % 9 = 0").withColumnRenamed("seq_id", "query_id")
    s = seqs.withColumn("cluster_id", F.col("seq_id") % 7)
    routes = q.select("query_id").crossJoin(s.select("cluster_id").distinct()).filter("(query_id + cluster_id) % 3 = 0")
    sent = search.bounded_pairs(routes, q, s, 3)
    assert "BroadcastHashJoin [h#" in sent._jdf.queryExecution().sparkPlan().toString()
    want = rows(sent)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert rows(search.bounded_pairs(routes, q, s, 3)) == want and len(want) > 100
