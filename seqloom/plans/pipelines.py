"""The three entry points: partitioning a database, routed search, and all-pairs comparison of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DEFAULT, Alphabet
from ..operators.allpairs import compare
from ..operators.clustering import cluster, union_centers
from ..operators.kmers import compressed, long_form, presence_rows, translate
from ..operators.routing import count_cluster_hits, count_query_maps, route, strict_join
from ..operators.alignment import LOCAL_SCALE
from ..operators.search import aligned, best_first, best_hits, bounded_pairs
from ..session import cut
from ..sources.fasta import number_sequences, read_fasta, write_meta, write_partitions, write_simple_fasta
from ..sources.pipe import Program, search_clusters, search_pairs
from . import manifest

STEPS = ("transform", "cluster", "write", "union")


def partition_database(seqs: DataFrame, n_clusters: int, k: int = 3, stride: int | None = None, base: int | None = None, update: str = "mean", max_iter: int = 8, out: str | None = None, steps: tuple[str, ...] = STEPS, start: str | None = None, sample: str = "first", seed: int = 0) -> dict[str, DataFrame]:
    """Results of the steps up to the last of ``steps``: vectors, assignment, partitions (written as FASTA), centers.

    Under ``out`` every step stores its result, vectors in rows (seq_id, hashes), and a manifest notes it with its parameters.  A run with ``start`` takes the steps before that one from
    there; it raises if one of them has not finished since the ones before it, or was run with other parameters.
    """
    spark, last = seqs.sparkSession, max((STEPS.index(s) for s in steps), default=-1)
    of = {"transform": {"k": k, "stride": stride, "base": base}}
    of["cluster"] = of["transform"] | {"n_clusters": n_clusters, "update": update, "max_iter": max_iter, "sample": sample, "seed": seed}
    of |= {"write": of["cluster"], "union": of["cluster"]}
    first = STEPS.index(start or STEPS[0])
    if first:
        if not out:
            raise ValueError("a start needs the folder of the steps before it")
        manifest.require(spark, out, start, STEPS, of)

    def stored(step: str, name: str, make, write=None) -> DataFrame:
        at = f"{out}/{name}"
        if STEPS.index(step) >= first:
            df = make()
            if not out:
                return df
            (write or (lambda d: d.write.mode("overwrite").parquet(at)))(df)
            manifest.record(spark, out, step, STEPS, of[step])
            if write:
                return df
        return spark.read.parquet(at)

    rows = stored("transform", "vectors", lambda: presence_rows(seqs, k, stride, base) if out else cut(presence_rows(seqs, k, stride, base), "presence"))
    r = {"vectors": long_form(rows)}
    if last >= 1:
        r["assignment"] = stored("cluster", "assignment", lambda: cluster(rows, seqs, n_clusters, update, max_iter, sample=sample, seed=seed)[0])
    if last >= 2:
        joined = strict_join(seqs, r["assignment"])
        r["partitions"] = stored("write", "partitions", lambda: joined, lambda d: write_partitions(d, f"{out}/partitions")) if first <= 2 else joined
    if last >= 3:
        r["centers"] = stored("union", "centers", lambda: union_centers(rows, r["assignment"]))
    return r


def search(queries: DataFrame, centers: DataFrame, partitions: DataFrame, k: int = 3, min_matches: int = 1, min_fraction: float | None = None, base: int | None = None, drop_last: bool = True, method: str = "native", program: Program | None = None, **costs) -> DataFrame:
    """(query_id, cluster_id, seq_id, score, distance): local alignment of each query (query_id, seq) with every sequence of
    the clusters it is routed to, or, by method ``external``, the hits that ``program`` finds there."""
    routes = route(queries, centers, k, min_matches, min_fraction, base, drop_last).select("query_id", "cluster_id")
    if method == "native":
        return aligned(routes.join(partitions.select("cluster_id", "seq_id"), "cluster_id"), queries, partitions, **costs)
    if method != "external" or program is None:
        raise ValueError(f"unknown method {method!r}, or no program given")
    return _with_distance(search_clusters(routes.join(queries.select("query_id", "seq"), "query_id"), partitions, program))


def _with_distance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.call_function("div", F.lit(LOCAL_SCALE).cast("bigint"), F.col("score") + 1).cast("bigint"))


top_hits = best_hits


def search_best(queries: DataFrame, centers: DataFrame, partitions: DataFrame, k: int = 3, min_matches: int = 1, min_fraction: float | None = None, base: int | None = None, drop_last: bool = True, bound_k: int = 5, first: int = 1, growth: int = 4, method: str = "native", program: Program | None = None, **costs) -> tuple[DataFrame, list[int]]:
    """(top_hits(search(...)), pairs aligned in each round), by aligning only pairs whose bound can beat the best hit so far: ``first`` of each query,
    then ``growth`` times as many a round.  Few rounds suit few pairs a query, many rounds align fewer.

    By method ``external`` ``program`` aligns the pairs.  Its scores must be local scores by ``costs``, or lower; one above its pair's bound raises."""
    if method not in ("native", "external") or (method == "external") != (program is not None):
        raise ValueError(f"unknown method {method!r}, or no program given")
    by_program = lambda pairs, q, p, **_: _with_distance(search_pairs(pairs, q, p, program))
    routes = cut(route(queries, centers, k, min_matches, min_fraction, base, drop_last).select("query_id", "cluster_id"), "routes")
    return best_first(bounded_pairs(routes, queries, partitions, bound_k, **costs), queries, partitions, first, growth, by_program if program else aligned, **costs)


def metrics(queries: DataFrame, centers: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(clusters per query, queries per cluster)."""
    routes = cut(route(queries, centers, **options), "routes")
    return count_query_maps(queries, routes), count_cluster_hits(routes)


def align_fasta(spark: SparkSession, path: str, out: str, method: str = "kmer", alphabet: Alphabet | None = DEFAULT, dna: bool = True, strategy: str = "auto", **options) -> DataFrame:
    """All pairs of the sequences in FASTA files: numbered, written as simple FASTA with a meta file, translated in six frames if
    ``dna``, compressed by ``alphabet`` if given, and compared.  Results go to ``out``/pairs as ``a,b<TAB>distance``."""
    seqs = cut(number_sequences(read_fasta(spark, path)), "sequences")
    write_simple_fasta(seqs, f"{out}/sequences")
    write_meta(seqs, f"{out}/meta")
    seqs = seqs.select("seq_id", F.upper("seq").alias("seq"))
    if dna:
        seqs = translate(seqs).select(F.col("frame_id").alias("seq_id"), "seq")
    if alphabet:
        seqs = compressed(seqs, alphabet, "error")
    found = cut(compare(seqs, method, strategy, **options), "pairs")
    found.select(F.concat_ws(",", "id_a", "id_b"), "distance").write.mode("overwrite").option("sep", "\t").csv(f"{out}/pairs")
    return found
