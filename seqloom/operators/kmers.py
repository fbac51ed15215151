"""Table-generating operators: frames, compressed sequences, k-mers, presence vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alphabet import DEFAULT, RESIDUES, Alphabet, ScoringMatrix
from ..functions.sequences import compress, kmers
from . import residues


def schemas(rows: DataFrame, keep: tuple[str, ...], ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL(ddl).fields])
    return s, to_arrow_schema(s)


def translate(seqs: DataFrame, drop_last: bool = False) -> DataFrame:
    """(frame_id, seq_id, frame, seq): the six frames of each DNA sequence, as six_frames() has them; frame_id = 6 * seq_id + frame, so frames of
    different sequences never share an id."""
    rows = seqs.select("seq_id", "seq")
    schema, arrow = schemas(rows, ("seq_id",), "frame int, seq string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in residues.blocks(batches):
            for frame, at, found in residues.six_frames(b.column(1), drop_last):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), frame, np.int32)), found], schema=arrow)

    f = rows.mapInArrow(work, schema)
    return f.select((6 * F.col("seq_id") + F.col("frame")).alias("frame_id"), "seq_id", F.col("frame").cast("bigint"), "seq")


def compressed(seqs: DataFrame, alphabet: Alphabet = DEFAULT, missing: str = "error") -> DataFrame:
    return seqs.withColumn("seq", compress(F.col("seq"), alphabet, missing))


def _hashed(seqs: DataFrame, keep: tuple[str, ...], ddl: str, make: Callable[..., Iterator[tuple]], k: int, stride: int, drop_last: bool, base: int | None, letters: str) -> DataFrame:
    """(``keep`` columns, what ``make`` gives) of the k-mers of blocks of rows; a row number comes first in what it gives, if there are columns to keep."""
    rows, base = seqs.select(*keep, "seq"), base or k
    schema, arrow = schemas(rows, keep, ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((b, residues.hashes(b.column(len(keep)), k, stride, drop_last, base, letters)) for b in residues.blocks(batches))
        for b, at, *columns in make(found):
            kept = [b.column(i).take(pa.array(at)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keep):]))], schema=arrow)

    return rows.mapInArrow(work, schema)


def hashed_kmers(seqs: DataFrame, k: int = 3, stride: int = 1, drop_last: bool = False, base: int | None = None, keep: tuple[str, ...] = ("seq_id",), letters: str = "residue") -> DataFrame:
    """(``keep`` columns, h): a row per k-mer without ambiguous residues, hashed as kmer_hash() or, for ``letters`` "class", compressed_kmer_hash() does."""
    return _hashed(seqs, keep, "h bigint", lambda found: ((b, row[good], h[good]) for b, (row, h, good) in found), k, stride, drop_last, base, letters)


def counted_kmers(seqs: DataFrame, k: int = 3, stride: int = 1, drop_last: bool = False, base: int | None = None, keep: tuple[str, ...] = ("seq_id",), letters: str = "residue") -> DataFrame:
    """(``keep`` columns, h, n): the same with each row's equal hashes counted or, without columns to keep, those of many rows.  Rows may share
    what is kept, and a hash come from several tasks: sums are left to the caller."""

    def by_row(found):
        for b, (row, h, good) in found:
            yield b, *residues.counted(row[good], h[good])

    def by_task(found):
        held, size = [], 0
        for b, (row, h, good) in found:
            held.append(residues.counted(np.zeros_like(row[good]), h[good])[1:])
            size += len(held[-1][0])
            if size >= 2 * residues.HELD:
                held = [residues.summed(held)]
                size = len(held[0][0])
                if size >= residues.HELD:
                    yield b, None, *held.pop()
                    size = 0
        if held:
            yield None, None, *residues.summed(held)

    return _hashed(seqs, keep, "h bigint, n bigint", by_row if keep else by_task, k, stride, drop_last, base, letters)


def counted_any(seqs: DataFrame, k: int, *keep: str) -> DataFrame:
    """(``keep`` columns, h, n): k-mers of any characters by a 64-bit hash, counted by row."""
    rows = seqs.select(*keep, "seq")
    schema, arrow = schemas(rows, keep, "h bigint, n bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in residues.blocks(batches):
            at, h, n = residues.counted(*residues.any_hashes(b.column(len(keep)), k))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(len(keep))), pa.array(h), pa.array(n)], schema=arrow)

    return rows.mapInArrow(work, schema)


def hash_arrays(seqs: DataFrame, k: int = 3, stride: int = 1, drop_last: bool = False, base: int | None = None) -> DataFrame:
    """(seq_id, hashes): an entry per k-mer, null for one with an ambiguous residue; null for a null sequence."""
    rows, base = seqs.select("seq_id", "seq"), base or k
    schema, arrow = schemas(rows, ("seq_id",), "hashes array<bigint>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in residues.blocks(batches):
            row, h, good = residues.hashes(b.column(1), k, stride, drop_last, base)
            bounds = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))), pa.int32(), mask=np.append(b.column(1).is_null().to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(bounds, pa.array(h, mask=~good)).cast(arrow.field(1).type)], schema=arrow)

    return rows.mapInArrow(work, schema)


def presence(seqs: DataFrame, k: int = 3, stride: int | None = None, base: int | None = None) -> DataFrame:
    """(seq_id, h), distinct: presence vectors in long form, of k-mers at ``stride`` (k by default, as databases have them).
    Rows are dealt out by seq_id, so that what follows by seq_id needs no shuffle of its own."""
    return counted_kmers(seqs, k, stride or k, False, base).select("seq_id", "h").repartition("seq_id").distinct()


def presence_in_place(seqs: DataFrame, k: int = 3, stride: int | None = None, base: int | None = None) -> DataFrame:
    """presence(), by a shuffle only if a seq_id is repeated, which is counted first: otherwise no row shares a vector with another one."""
    ids = seqs.groupBy("seq_id").agg(F.count("*").alias("n"))
    return counted_kmers(seqs, k, stride or k, False, base).select("seq_id", "h") if ids.filter("n > 1").isEmpty() else presence(seqs, k, stride, base)


def presence_rows(seqs: DataFrame, k: int = 3, stride: int | None = None, base: int | None = None) -> DataFrame:
    """(seq_id, hashes): presence() in a row per seq_id, also for one that has no k-mer.  Rows are shuffled only if a seq_id is repeated or null, which is counted first."""
    rows, stride, base = seqs.select("seq_id", "seq"), stride or k, base or k
    if not rows.groupBy("seq_id").agg(F.count("*").alias("n")).filter("n > 1 OR seq_id IS NULL").isEmpty():
        ids, v = rows.select("seq_id").distinct(), packed(presence(seqs, k, stride, base)).withColumnRenamed("seq_id", "_id")
        return ids.join(v, ids.seq_id.eqNullSafe(v["_id"]), "left").select("seq_id", F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))
    schema, arrow = schemas(rows, ("seq_id",), "hashes array<bigint>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in residues.blocks(batches):
            row, h, good = residues.hashes(b.column(1), k, stride, False, base)
            row, h, _ = residues.counted(row[good], h[good])
            yield pa.RecordBatch.from_arrays([b.column(0), residues.lists(row, h, b.num_rows).cast(arrow.field(1).type)], schema=arrow)

    return rows.mapInArrow(work, schema)


def packed(long_form: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, hashes): presence vectors as sorted arrays."""
    return long_form.groupBy(key).agg(F.array_sort(F.collect_set("h")).alias("hashes"))


def unpacked(vectors: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, h): ``vectors`` in long form."""
    return vectors.select(key, F.explode("hashes").alias("h"))


def long_form(vectors: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, h) of vectors in either form."""
    return unpacked(vectors, key) if "hashes" in vectors.columns else vectors.select(key, "h")


def kmer_counts(seqs: DataFrame, k: int = 3) -> DataFrame:
    """(seq_id, kmer, n): multiset of each sequence's k-mers."""
    km = seqs.select("seq_id", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return km.groupBy("seq_id", "kmer").agg(F.count("*").alias("n"))


def common_hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, common) of the vectors (a, h) and (b, h) that share a hash."""
    return left.join(right, "h").groupBy("a", "b").agg(F.count("*").alias("common"))


def neighbours(kmers: DataFrame, matrix: ScoringMatrix, threshold: int, k: int) -> DataFrame:
    """(kmer, neighbour, score): for each distinct ``k``-mer of residues in column kmer, all k-mers whose summed score with it is
    at least ``threshold``; k-mers with other letters, and nulls, have none.

    Branch and bound, one position at a time: a beginning stays only if the best scores of the positions to come can still lift it to the
    threshold, so what is held between positions are beginnings of neighbours only.  The table joined at each position has a row per residue.
    """
    spark, rows = kmers.sparkSession, {}
    for a, b, score in matrix.rows():
        if a in RESIDUES and b in RESIDUES:
            rows.setdefault(a, []).append((score, b))
    dimension = spark.createDataFrame([(a, [(s, b) for s, b in sorted(x, reverse=True)], max(x)[0]) for a, x in sorted(rows.items())], "residue string, others array<struct<s:bigint,to:string>>, top bigint")
    found = kmers.select("kmer").distinct().filter(F.length("kmer") == k)
    found = found.withColumn("_up", F.upper("kmer"))
    for i in range(k):  # what each position can add at most
        found = found.join(F.broadcast(dimension.select(F.col("residue").alias("_r"), F.col("others").alias(f"_o{i}"), F.col("top").alias(f"_t{i}"))), F.substring("_up", i + 1, 1) == F.col("_r")).drop("_r")
    found = found.withColumns({"neighbour": F.lit(""), "score": F.lit(0).cast("bigint")})
    for i in range(k):
        rest = sum((F.col(f"_t{j}") for j in range(i + 1, k)), F.lit(0))
        near = F.filter(f"_o{i}", lambda x: F.col("score") + x.s + rest >= threshold)  # noqa: B023
        found = found.withColumn("_next", F.explode(near))
        found = found.withColumns({"neighbour": F.concat("neighbour", "_next.to"), "score": F.col("score") + F.col("_next.s")}).drop("_next", f"_o{i}")
    return found.select("kmer", "neighbour", "score")
