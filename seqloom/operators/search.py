"""The best hit of each query without aligning every pair.

A local alignment's matching letters come in unbroken runs; a run of r >= k letters makes r - k + 1 k-mers that both sequences have.  With
c k-mers in common (occurrences, the lesser count of each) and runs, M <= c + runs * (k - 1) letters match, M is at most the shorter length,
and between two runs there is a mismatch or a gap.  That bounds the score from above.  Pairs are aligned best bound first, in rounds, and a pair
whose bound can't beat its query's best hit is never aligned.  Until then pairs are ids and a number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .alignment import EXTEND, GAP, MATCH, MISMATCH, with_local
from .clustering import BROADCAST_ROWS
from .kmers import counted_any


def local_bound(length: Column, common: Column, k: int, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, extend: int = EXTEND) -> Column:
    """At most the local score of two sequences, the shorter of which has ``length`` letters, with ``common`` k-mer occurrences in common."""
    if match < 0 or mismatch > 0 or gap + extend > 0 or k < 2:
        raise ValueError("bounds need a gain for matches, none for anything else, and k-mers of two letters or more")
    broken = min(-mismatch, -(gap + extend))
    if match * (k - 1) < broken:  # a second run never pays
        return match * F.least(length, common + (k - 1))
    runs = F.greatest(F.lit(1), F.ceil((length - common) / (k - 1)))
    return (match * length - broken * (runs - 1)).cast("bigint")


def _counted(seqs: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, h, n): k-mers of any characters by a 64-bit hash; where two share one, only more are in common."""
    return counted_any(seqs, k, *keys).groupBy(*keys, "h").agg(F.sum("n").alias("n"))


def bounded_pairs(routes: DataFrame, queries: DataFrame, partitions: DataFrame, k: int = 5, **costs: int) -> DataFrame:
    """(query_id, cluster_id, seq_id, common, max_length, bound) of each query and sequence of a cluster it is routed to, without texts.

    K-mers that no query has leave the database's side before it is shuffled.  If the queries' k-mers are few (BROADCAST_ROWS), they are sent to the
    database's, and what a sequence has in common with a query is summed up within its task; otherwise routes and k-mers meet by cluster and hash."""
    q = cut(_counted(queries, k, "query_id").withColumnRenamed("n", "n_q"), "asked")
    held = partitions.select("cluster_id", "seq_id", F.col("seq"))
    routed = held.join(routes.select("cluster_id").distinct(), "cluster_id", "left_semi")
    key = ["query_id", "cluster_id", "seq_id"]
    if q.count() <= BROADCAST_ROWS:
        met = counted_any(routed, k, "cluster_id", "seq_id").join(F.broadcast(q), "h")
    else:
        s = _counted(routed, k, "cluster_id", "seq_id").join(q.select("h").distinct(), "h", "left_semi")
        met = q.join(routes, "query_id").join(s, ["cluster_id", "h"])
    common = met.groupBy(*key).agg(F.sum(F.least("n_q", "n")).alias("common"))
    pairs = (routes.join(queries.select("query_id", F.length("seq").alias("_q")), "query_id").join(held.select("cluster_id", "seq_id", F.length("seq").alias("_s")), "cluster_id")
             .join(common, key, "left"))
    length, shared = F.coalesce(F.least("_q", "_s"), F.lit(0)).cast("bigint"), F.coalesce("common", F.lit(0)).cast("bigint")
    return pairs.select("query_id", "cluster_id", "seq_id", shared.alias("common"), length.alias("max_length")).withColumn("bound", local_bound(F.col("max_length"), F.col("common"), k, **costs))


def aligned(pairs: DataFrame, queries: DataFrame, partitions: DataFrame, **costs) -> DataFrame:
    """(query_id, cluster_id, seq_id, score, distance): texts join the ids, are dealt out evenly whatever cluster they come from, and aligned."""
    texts = (pairs.select("query_id", "cluster_id", "seq_id").join(partitions.select("cluster_id", "seq_id", F.col("seq").alias("seq_b")), ["cluster_id", "seq_id"])
             .join(queries.select("query_id", F.col("seq").alias("seq_a")), "query_id"))
    return with_local(texts.repartition(F.xxhash64("query_id", "seq_id")), **costs).select("query_id", "cluster_id", "seq_id", "score", "distance")


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each query: highest score, then lowest seq_id, then lowest cluster_id."""
    best = hits.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "seq_id", "cluster_id", "distance")).alias("b"))
    return best.select("query_id", "b.cluster_id", "b.seq_id", (-F.col("b.s")).alias("score"), "b.distance")


def best_first(pairs: DataFrame, queries: DataFrame, partitions: DataFrame, first: int = 1, growth: int = 4, align: Callable[..., DataFrame] = aligned, **costs) -> tuple[DataFrame, list[int]]:
    """(best_hits() of the ``pairs`` with bounds, pairs aligned in each round).

    A round aligns each query's next pairs by bound, ``first`` of them, then ``growth`` times as many each round, so the rounds are as many as the
    logarithm of the pairs.  After it, pairs go whose bound is below the best score so far, or equals it with a later id.  A round is
    written out, so lineage is short; so are the texts that are still needed after the first one, the only ones that later rounds read.
    ``align`` gives hits as aligned() does; a pair without any leaves its query's best as it is, and all pairs of a query without a best one stay.
    """
    left, best, take, counts = pairs.select("query_id", "cluster_id", "seq_id", "bound"), None, first, []
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seq_id", "cluster_id")
    while True:
        ranked = cut(left.withColumn("_rank", F.row_number().over(order)), "bounded")
        now = ranked.filter(F.col("_rank") <= take)
        hits = cut(align(now, queries, partitions, **costs), "hits")
        counts.append(now.count())
        best = cut(best_hits(hits if best is None else hits.unionByName(best)), "best")
        b = best.select("query_id", F.col("score").alias("_score"), F.struct("seq_id", "cluster_id").alias("_id"))
        can = (F.col("bound") > F.col("_score")) | ((F.col("bound") == F.col("_score")) & (F.struct("seq_id", "cluster_id") < F.col("_id")))
        left = ranked.filter(F.col("_rank") > take).join(b, "query_id", "left").filter(F.col("_score").isNull() | can).select("query_id", "cluster_id", "seq_id", "bound")
        if left.isEmpty():
            return best, counts
        if len(counts) == 1:
            partitions = cut(partitions.select("cluster_id", "seq_id", "seq").join(left.select("cluster_id", "seq_id").distinct(), ["cluster_id", "seq_id"], "left_semi"), "texts")
        take *= growth
