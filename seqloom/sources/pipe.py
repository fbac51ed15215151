"""Running an external program over each cluster's records, or over them and the queries that a cluster takes.

A program comes with its files in an archive (zip, tar, tar.gz) that Spark sends to every executor and unpacks there.  No call is given more than a
stated amount: clusters are counted first and dealt out in parts, queries in blocks, and each part meets each block once.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Program:
    """``command`` may hold {database}, {queries} and {cluster}, for two FASTA files and the cluster's id, and {archive}, for the folder that
    ``archive`` is unpacked to on the executor.  It prints a line per hit, tab-separated, with query, sequence and score in ``fields``
    (from 0; 0, 1 and 11 in the usual tabular form); lines that begin with # are remarks."""

    command: tuple[str, ...]
    archive: str | None = None
    fields: tuple[int, int, int] = (0, 1, 2)


def add_archive(spark: SparkSession, archive: str | None) -> str | None:
    """Name of the folder that ``archive`` is unpacked to on every executor, now or later in this session's life."""
    if archive is None:
        return None
    name = os.path.basename(archive).partition(".")[0]
    spark.sparkContext.addArchive(f"{archive}#{name}")
    return name


def _fasta(ids: pa.ChunkedArray, seqs: pa.ChunkedArray) -> str:
    with tempfile.NamedTemporaryFile("w", suffix=".fa", delete=False) as f:
        f.writelines(f">{i}\n{s or ''}\n" for i, s in zip(ids.to_pylist(), seqs.to_pylist()))
    return f.name


def _run(command: tuple[str, ...] | list[str], folder: str | None, cluster, merge: bool = False, **files: str) -> str:
    """What the program prints; a failure raises with what it said.  The files of the call, which only it reads, go afterwards."""
    names = {"{cluster}": str(cluster), "{archive}": SparkFiles.get(folder) if folder else "", **{f"{{{k}}}": v for k, v in files.items()}}
    argv = list(command)
    for k, v in names.items():
        argv = [x.replace(k, v) for x in argv]
    try:
        done = subprocess.run(argv, stdout=subprocess.PIPE, stderr=subprocess.STDOUT if merge else subprocess.PIPE, text=True)
    finally:
        for f in files.values():
            os.unlink(f)
    if done.returncode:
        raise RuntimeError(f"{argv[0]} ended with {done.returncode} for cluster {cluster}: {(done.stderr or done.stdout)[-500:]}")
    return done.stdout


def pipe_clusters(records: DataFrame, command: list[str], batch_records: int = 100_000, archive: str | None = None) -> DataFrame:
    """(cluster_id, output): standard output and error of ``command`` for the records (cluster_id, seq_id, seq) of each cluster.

    ``{fasta}``, ``{cluster}`` and ``{archive}`` in the command stand for a FASTA file, the cluster's id and the unpacked archive.  A cluster of more than
    ``batch_records`` records is dealt over several tasks and calls.
    """
    folder = add_archive(records.sparkSession, archive)

    def call(cluster: int, rows: pd.DataFrame) -> str:
        with tempfile.NamedTemporaryFile("w", suffix=".fa", delete=False) as f:
            f.writelines(f">{i} {s}\n" for i, s in zip(rows.seq_id, rows.seq.fillna("")))
        return _run(command, folder, cluster, True, fasta=f.name)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, pd.DataFrame()
        out = lambda rows: pd.DataFrame({"cluster_id": [key[0]], "output": [call(key[0], rows)]})
        for batch in batches:
            for name, rows in batch.groupby(["cluster_id", "part"], sort=False):
                if name != key and len(held):
                    yield out(held)
                held = rows if name != key else pd.concat([held, rows])
                key = name
                while len(held) >= batch_records:
                    yield out(held[:batch_records])
                    held = held[batch_records:]
        if len(held):
            yield out(held)

    parts = records.groupBy("cluster_id").agg(F.ceil(F.count("*") / batch_records).cast("bigint").alias("parts"))
    dealt = records.select("cluster_id", "seq_id", "seq").join(parts, "cluster_id").withColumn("part", F.pmod(F.xxhash64("seq_id"), F.col("parts"))).drop("parts")
    return dealt.repartition("cluster_id", "part").sortWithinPartitions("cluster_id", "part", "seq_id").mapInPandas(work, "cluster_id bigint, output string")


def search_clusters(queries: DataFrame, records: DataFrame, program: Program, batch_letters: int = 50_000_000, batch_queries: int = 10_000) -> DataFrame:
    """(query_id, cluster_id, seq_id, score): the hits that ``program`` prints for the queries (cluster_id, query_id, seq) of each cluster and its
    records (cluster_id, seq_id, seq).

    A call gets about ``batch_letters`` of a cluster's letters and ``batch_queries`` of its queries.  Clusters without queries aren't touched.
    Clusters that take the same queries share calls, so that many small ones don't start a program each, unless the command names {cluster}.
    """
    folder = add_archive(queries.sparkSession, program.archive)
    sets = queries.select("cluster_id", F.col("query_id").alias("_q")).distinct().groupBy("cluster_id").agg(F.concat_ws(
        ":", F.count("*"), F.bit_xor(F.xxhash64("_q")), F.bit_xor(F.xxhash64("_q", F.lit(1)))).alias("set"), F.first("cluster_id").alias("_c"))
    if any("{cluster}" in x for x in program.command):
        sets = sets.withColumn("set", F.col("_c").cast("string"))
    sets = cut(sets.drop("_c"), "sets")
    first = sets.groupBy("set").agg(F.min("cluster_id").alias("cluster_id"))  # whose queries stand for those of all of its set
    queries = queries.join(first, "cluster_id").select("set", "query_id", "seq")
    records = records.join(sets, "cluster_id").select("set", "cluster_id", "seq_id", "seq")
    asked = queries.groupBy("set").agg(F.ceil(F.count("*") / batch_queries).cast("bigint").alias("blocks"))
    parts = records.groupBy("set").agg(F.greatest(F.ceil(F.sum(F.length("seq")) / batch_letters), F.lit(1)).cast("bigint").alias("parts"))
    plan = asked.join(parts, "set")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    d = records.join(plan, "set").select("set", "cluster_id", F.pmod(F.xxhash64("seq_id"), F.col("parts")).alias("part"), each("blocks").alias("block"), "seq_id", "seq")
    q = queries.join(plan, "set").select(F.col("set").alias("set"), each("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "seq")

    query, seq, score = program.fields

    def call(own: pa.Table, held: pa.Table) -> pa.Table:
        lines, of = [], {}
        if len(own) and len(held):  # the hash may leave a part or a block empty
            for c, i in zip(held["cluster_id"].to_pylist(), held["seq_id"].to_pylist()):
                of.setdefault(str(i), []).append(c)
            once = held.take(pa.array(list(dict(zip(reversed(held["seq_id"].to_pylist()), range(len(held) - 1, -1, -1))).values()))) if len(of) < len(held) else held
            said = _run(program.command, folder, held["cluster_id"][0].as_py(), queries=_fasta(own["query_id"], own["seq"]), database=_fasta(once["seq_id"], once["seq"]))
            lines = [x for x in said.splitlines() if x and not x.startswith("#")]
        found = [(c, x) for x in lines for c in of[x.split("\t")[seq].strip()]]
        return pa.table({"cluster_id": pa.array([c for c, _ in found], pa.int64()), "line": pa.array([x for _, x in found], pa.string())})

    key, tasks = ("set", "part", "block"), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, d = q.repartition(tasks, *key), d.repartition(tasks, *key)  # a stated number, as small texts may be long calls
    lines = q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(call, "cluster_id bigint, line string")
    f = F.split("line", "\t")
    return lines.select(F.trim(f[query]).cast("bigint").alias("query_id"), "cluster_id", F.trim(f[seq]).cast("bigint").alias("seq_id"), F.trim(f[score]).cast("double").cast("bigint").alias("score"))


def search_pairs(pairs: DataFrame, queries: DataFrame, partitions: DataFrame, program: Program, batch_letters: int = 5_000_000) -> DataFrame:
    """(query_id, cluster_id, seq_id, score): the hits that ``program`` finds in ``pairs`` (query_id, cluster_id, seq_id, bound) and no others.

    A call gets a query and the sequences that it is paired with, as if these were a cluster, so the command can't name {cluster}.  A score above its pair's bound
    raises, as whoever left other pairs out relied on it."""
    if any("{cluster}" in x for x in program.command):
        raise ValueError("the program is given pairs, not clusters")
    once = pairs.groupBy("query_id", "seq_id").agg(F.min("cluster_id").alias("cluster_id"))
    texts = cut(partitions.select("cluster_id", "seq_id", "seq").join(once, ["cluster_id", "seq_id"]).select(F.col("query_id").alias("cluster_id"), "seq_id", "seq"), "paired")
    asked = queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi").select(F.col("query_id").alias("cluster_id"), "query_id", "seq")
    hits = pairs.select("query_id", "cluster_id", "seq_id", "bound").join(search_clusters(asked, texts, program, batch_letters).drop("cluster_id"), ["query_id", "seq_id"])
    said = F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(" of query "), F.col("query_id").cast("string"), F.lit(" is above its bound "), F.col("bound").cast("string"))
    return hits.select("query_id", "cluster_id", "seq_id", F.when(F.col("score") <= F.col("bound"), F.col("score")).otherwise(F.raise_error(said).cast("bigint")).alias("score"))
