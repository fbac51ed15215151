"""Query routing: which clusters share enough k-mers with a query.  Works on batch and streaming queries with static centers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import ScoringMatrix
from ..functions.sequences import kmer_hash, kmers
from .kmers import counted_kmers, hashed_kmers, neighbours


def query_kmers(queries: DataFrame, k: int = 3, base: int | None = None, drop_last: bool = True, stride: int = 1) -> DataFrame:
    """(query_id, h) of the queries (query_id, seq): one row per occurrence."""
    return hashed_kmers(queries, k, stride, drop_last, base, keep=("query_id",))


def route(queries: DataFrame, centers: DataFrame, k: int = 3, min_matches: int = 1, min_fraction: float | None = None, base: int | None = None, drop_last: bool = True) -> DataFrame:
    """(query_id, cluster_id, n_matches): clusters whose center (cluster_id, h) has at least ``min_matches`` of the query's k-mer
    occurrences, or that fraction of them.  The k-mers of a query are first counted by hash, so each meets the centers once."""
    q = counted_kmers(queries, k, 1, drop_last, base, keep=("query_id",)).groupBy("query_id", "h").agg(F.sum("n").alias("n"))
    hits = q.join(centers, "h").groupBy("query_id", "cluster_id").agg(F.sum("n").alias("n_matches"))
    if min_fraction is not None:
        total = q.groupBy("query_id").agg(F.sum("n").alias("total"))
        hits = hits.join(total, "query_id").filter(F.col("n_matches") >= min_fraction * F.col("total")).drop("total")
    return hits.filter(F.col("n_matches") >= min_matches)


def route_by_neighbours(queries: DataFrame, centers: DataFrame, matrix: ScoringMatrix, threshold: int, k: int = 3, min_matches: int = 1, min_fraction: float | None = None, base: int | None = None, drop_last: bool = True) -> DataFrame:
    """As route(), but an occurrence of a query's k-mer matches if the center has any k-mer that scores ``threshold`` or more with it.

    The neighbourhoods of the queries' distinct k-mers are enumerated once, as a table between the queries and the centers; a k-mer that meets a
    center by several neighbours counts once."""
    q = queries.select("query_id", F.explode(kmers(F.upper("seq"), k, 1, drop_last)).alias("kmer")).groupBy("query_id", "kmer").agg(F.count("*").alias("n"))
    q = q.filter(kmer_hash(F.col("kmer"), k, base).isNotNull())
    near = neighbours(q, matrix, threshold, k).select("kmer", kmer_hash(F.col("neighbour"), k, base).alias("h")).distinct()
    hits = near.join(centers, "h").select("kmer", "cluster_id").distinct()
    found = q.join(hits, "kmer").groupBy("query_id", "cluster_id").agg(F.sum("n").alias("n_matches"))
    if min_fraction is not None:
        found = found.join(q.groupBy("query_id").agg(F.sum("n").alias("total")), "query_id").filter(F.col("n_matches") >= min_fraction * F.col("total")).drop("total")
    return found.filter(F.col("n_matches") >= min_matches)


def count_query_maps(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """(query_id, n_clusters), 0 for queries that no cluster takes."""
    n = routes.groupBy("query_id").agg(F.count("*").alias("n_clusters"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))


def count_cluster_hits(routes: DataFrame) -> DataFrame:
    """(cluster_id, n_queries) of the clusters that take a query."""
    return routes.groupBy("cluster_id").agg(F.count("*").alias("n_queries"))


def partition_join(seqs: DataFrame, assignment: DataFrame) -> DataFrame:
    """``seqs`` with cluster_id; raises if an id is missing or repeated on either side."""
    a = assignment.select("seq_id", "cluster_id")
    one = lambda d, name: d.groupBy("seq_id").agg(F.count("*").alias(name))
    odd = one(seqs, "n").join(one(a, "m"), "seq_id", "full_outer").filter((F.coalesce("n", F.lit(0)) != 1) | (F.coalesce("m", F.lit(0)) != 1)).limit(1).collect()
    if odd:
        raise ValueError(f"sequence {odd[0].seq_id} is not on both sides exactly once")
    return seqs.join(a, "seq_id")


def strict_join(seqs: DataFrame, assignment: DataFrame) -> DataFrame:
    """As partition_join(), but lazy: a join with both sides' counts by id tells ids that are missing or repeated on either side, and the first
    such row that is computed raises an error.  Ids are counted by themselves, without the texts, which are shuffled once and never sorted."""
    a = assignment.groupBy("seq_id").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("_m"))
    n = seqs.groupBy("seq_id").agg(F.count("*").alias("_n")).withColumnRenamed("seq_id", "_other")
    ids = a.join(n, F.col("seq_id") == F.col("_other"), "full_outer").select(F.coalesce("seq_id", "_other").alias("_id"), "cluster_id", "_m", "_n")
    j = seqs.drop("cluster_id").join(ids.hint("shuffle_hash"), F.col("seq_id") == F.col("_id"), "full_outer")
    fine = F.col("seq_id").isNotNull() & (F.col("_m") == 1) & (F.col("_n") == 1)
    said = F.raise_error(F.concat(F.lit("sequence "), F.coalesce(F.coalesce("seq_id", "_id").cast("string"), F.lit("null")), F.lit(" is not on both sides exactly once")))
    return j.filter(F.when(fine, F.lit(True)).otherwise(said.cast("boolean"))).drop("_id", "_m", "_n")


def membership_join(membership: DataFrame, seqs: DataFrame) -> DataFrame:
    """(cluster_id, seq_id, seq) from lists (cluster_id, members) of ids; unknown members are dropped."""
    return membership.select("cluster_id", F.explode("members").alias("seq_id")).join(seqs, "seq_id")


def parse_membership(lines: DataFrame) -> DataFrame:
    """(cluster_id, members) from lines ``cluster<TAB>id<TAB>id...`` in column value."""
    f = F.split("value", "\t")
    return lines.select(f[0].cast("bigint").alias("cluster_id"), F.slice(f, 2, F.size(f)).cast("array<bigint>").alias("members"))


def cluster_vectors(membership: DataFrame, seqs: DataFrame, k: int = 3, base: int | None = None) -> DataFrame:
    """(cluster_id, h), distinct, of the members' k-mers at every offset."""
    return counted_kmers(membership_join(membership, seqs), k, 1, False, base, keep=("cluster_id",)).select("cluster_id", "h").distinct()


def membership_lines(assignment: DataFrame, most: int = 100_000) -> DataFrame:
    """(value): lines ``cluster<tab>id<tab>id...``, as parse_membership() reads them; a cluster of more than ``most``
    members is dealt over several lines, so that no row holds a whole cluster."""
    sizes = assignment.groupBy("cluster_id").agg(F.ceil(F.count("*") / most).cast("bigint").alias("parts"))
    dealt = assignment.join(sizes, "cluster_id").withColumn("part", F.pmod(F.xxhash64("seq_id"), F.col("parts")))
    lines = dealt.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list("seq_id")).alias("ids"))
    return lines.select(F.concat_ws("\t", F.col("cluster_id").cast("string"), F.array_join("ids", "\t")).alias("value"))
