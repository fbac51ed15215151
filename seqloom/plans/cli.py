"""Command line: ``python -m seqloom.plans.cli <command> ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ..functions.alphabet import A20, Alphabet
from ..operators.clustering import cluster, union_centers
from ..operators.kmers import presence, translate
from ..operators.routing import cluster_vectors, membership_lines, parse_membership
from ..session import build, ship
from ..sources.pipe import Program
from ..sources.fasta import number_sequences, read_fasta, read_partitions, write_meta, write_simple_fasta, write_tsv
from .pipelines import STEPS, align_fasta, metrics, partition_database, search, search_best, top_hits


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options):
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return c

    c = command("partition", "database", "out", clusters=16, k=3, stride=0, base=0, max_iter=8, update="mean", sample="first", seed=0)
    c.add_argument("--steps", nargs="*", choices=STEPS, default=list(STEPS))
    c.add_argument("--start", choices=STEPS, help="take the steps before this one from what an earlier run stored")
    c = command("search", "queries", "database", "out", k=3, base=0, min_matches=1, min_fraction=0.0, archive=None)
    c.add_argument("--best", action="store_true", help="align only pairs that can be a query's best hit")
    c.add_argument("--program", nargs=argparse.REMAINDER, help="external program instead; {queries}, {database}, {cluster} and {archive} are replaced")
    command("cluster", "vectors", "out", clusters=16, max_iter=8, update="mean", sample="first", seed=0)
    command("union-vectors", "vectors", "assignment", "out")
    command("membership", "assignment", "out", most=100_000)
    command("cluster-vectors", "membership", "fasta", "out", k=3, base=0)
    command("align", "fasta", "out", method="kmer", alphabet=A20, strategy="auto").add_argument("--protein", action="store_true")
    command("vectors", "fasta", "out", k=3, stride=0, base=0)
    command("metrics", "queries", "database", "out", k=3, base=0, min_matches=1)
    command("simple-fasta", "fasta", "out", shards=114)
    command("translate", "fasta", "out", shards=114)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = ship(build(a.master, f"seqloom {a.command}"))

    def read(path: str):
        return number_sequences(read_fasta(spark, path))

    def queries():
        return read(a.queries).select(F.col("seq_id").alias("query_id"), F.upper("seq").alias("seq"))

    def assigned():
        return spark.read.schema("seq_id bigint, cluster_id bigint").option("sep", "\t").csv(a.assignment)

    base = getattr(a, "base", 0) or None
    if a.command == "partition":
        seqs = read(a.database).select("seq_id", "description", F.upper("seq").alias("seq"))
        partition_database(seqs, a.clusters, a.k, a.stride or None, base, a.update, a.max_iter, a.out, tuple(a.steps), a.start, a.sample, a.seed)
    elif a.command == "search":
        place = queries(), spark.read.parquet(f"{a.database}/centers"), read_partitions(spark, f"{a.database}/partitions"), a.k, a.min_matches, a.min_fraction or None, base
        if a.best:
            hits = search_best(*place)[0]
        elif a.program:
            hits = top_hits(search(*place, method="external", program=Program(tuple(a.program), a.archive)))
        else:
            hits = top_hits(search(*place))
        write_tsv(hits, a.out)
    elif a.command == "cluster":
        v = spark.read.parquet(a.vectors)  # in either form
        found, centers = cluster(v, v.select("seq_id"), a.clusters, a.update, a.max_iter, sample=a.sample, seed=a.seed)
        write_tsv(found.select("seq_id", "cluster_id"), f"{a.out}/assignment")
        centers.write.mode("overwrite").parquet(f"{a.out}/centers")
    elif a.command == "union-vectors":
        union_centers(spark.read.parquet(a.vectors), assigned()).write.mode("overwrite").parquet(a.out)
    elif a.command == "membership":
        membership_lines(assigned(), a.most).write.mode("overwrite").text(a.out)
    elif a.command == "cluster-vectors":
        seqs = read(a.fasta).select("seq_id", F.upper("seq").alias("seq"))
        cluster_vectors(parse_membership(spark.read.text(a.membership)), seqs, a.k, base).write.mode("overwrite").parquet(a.out)
    elif a.command == "align":
        align_fasta(spark, a.fasta, a.out, a.method, Alphabet.parse(a.alphabet), not a.protein, a.strategy)
    elif a.command == "vectors":
        presence(read(a.fasta).select("seq_id", F.upper("seq").alias("seq")), a.k, a.stride or None, base).write.mode("overwrite").parquet(a.out)
    elif a.command == "metrics":
        per_query, per_cluster = metrics(queries(), spark.read.parquet(f"{a.database}/centers"), k=a.k, min_matches=a.min_matches, base=base)
        write_tsv(per_query, f"{a.out}/queries")
        write_tsv(per_cluster, f"{a.out}/clusters")
    elif a.command == "simple-fasta":
        seqs = read(a.fasta)
        write_simple_fasta(seqs, f"{a.out}/sequences", a.shards)
        write_meta(seqs, f"{a.out}/meta")
    elif a.command == "translate":
        frames = translate(read(a.fasta).select("seq_id", F.upper("seq").alias("seq")), drop_last=True)
        write_simple_fasta(frames.select(F.col("frame_id").alias("seq_id"), "seq"), a.out, a.shards)


if __name__ == "__main__":
    main()
