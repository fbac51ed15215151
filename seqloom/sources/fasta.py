"""FASTA reading and writing.

Files are scanned in splits, one row per record; headers and bodies are cut by built-in functions, so any number of
files of any size reads in parallel.  Ids are given in file and record order by counts per split, not by a global sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import parse_id, parse_sequence
from ..session import cut

EXTENSIONS = r"\.(fa|fasta|fsa_aa|faa|fna)$"


def read_fasta(spark: SparkSession, path: str | list[str], head_sep: str = ">", line_sep: str = "", strict: bool = True) -> DataFrame:
    """(ext_id, description, seq, source_file, split_start, split_row) of every record.

    ``line_sep`` joins body lines (a blank suits quality files).  Text before the first header raises an error, or is skipped
    if not ``strict``; empty files give nothing.
    """
    scan = spark.read.option("lineSep", f"\n{head_sep}").text(path)
    raw = scan.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("_at"))
    raw = raw.filter(~F.col("source_file").rlike(r"\.sfm$"))
    #: only a file's first record still has its separator, and only there may it be missing
    first = raw.groupBy("source_file").agg(F.min(F.struct("split_start", "_at")).alias("f"))
    raw = raw.join(first, "source_file")
    is_first = (F.col("f.split_start") == F.col("split_start")) & (F.col("f._at") == F.col("_at"))
    blank = F.trim(F.regexp_replace("value", r"[\r\n]", "")) == ""
    raw = raw.filter(~(is_first & blank))
    begins = F.col("value").startswith(head_sep)
    if not strict:
        raw = raw.filter(~is_first | begins)
    body = F.when(~is_first, F.col("value")).when(begins, F.substring(F.col("value"), F.lit(len(head_sep) + 1), F.length("value"))).otherwise(
        F.raise_error(F.concat(F.lit("no header at the start of "), F.col("source_file"))).cast("string"))
    body = F.regexp_replace(body, r"\r", "")
    head = F.regexp_extract(body, r"^([^\n]*)", 1)
    lines = F.regexp_extract(body, r"^[^\n]*\n([\s\S]*)$", 1)
    r = raw.select(head.alias("head"), F.regexp_replace(F.regexp_replace(lines, r"\n+$", ""), r"\n", line_sep).alias("seq"), "source_file", "split_start", "_at")
    return r.select(F.regexp_extract("head", r"^(\S*)", 1).alias("ext_id"), F.regexp_extract("head", r"^\S*\s+([\s\S]*)$", 1).alias("description"), "seq", "source_file", "split_start", F.col("_at").alias("split_row"))


def number_sequences(records: DataFrame) -> DataFrame:
    """(seq_id, ext_id, description, seq, source_file): ids from 0 in order of file name and place in the file."""
    records = cut(records, "fasta")
    counts = records.groupBy("source_file", "split_start").agg(F.count("*").alias("n"))
    before = Window.orderBy("source_file", "split_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    base = counts.select("source_file", "split_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("source_file", "split_start").orderBy("split_row")
    r = records.withColumn("_k", F.row_number().over(own) - 1).join(base, ["source_file", "split_start"])
    return r.select((F.col("base") + F.col("_k")).alias("seq_id"), "ext_id", "description", "seq", "source_file")


def simple_line(seq_id: str = "seq_id", seq: str = "seq") -> Column:
    return F.concat(F.lit(">"), F.col(seq_id).cast("string"), F.lit(" "), F.coalesce(F.col(seq), F.lit("")))


def write_simple_fasta(seqs: DataFrame, path: str, shards: int | None = None) -> None:
    """``>id SEQ`` lines in id order, in ``shards`` range-partitioned files if given; overwrites."""
    ordered = seqs.repartitionByRange(shards, "seq_id") if shards else seqs.repartitionByRange("seq_id")
    ordered.sortWithinPartitions("seq_id").select(simple_line().alias("value")).write.mode("overwrite").text(path)


def read_simple_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(seq_id, seq); blank lines are skipped, malformed ones raise, or are skipped too if not ``strict``."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    if not strict:
        lines = lines.filter(F.col("value").rlike(r"^>\d+[ \t]"))
    return lines.select(parse_id(F.col("value")).alias("seq_id"), parse_sequence(F.col("value")).alias("seq"))


def write_meta(seqs: DataFrame, path: str) -> None:
    """The count, then ``id external-id`` lines in id order."""
    count = seqs.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("bigint").alias("k"), "value")
    lines = seqs.select(F.col("seq_id").alias("k"), F.concat_ws(" ", F.col("seq_id").cast("string"), "ext_id").alias("value"))
    count.union(lines).repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def header_tokens(records: DataFrame) -> DataFrame:
    """``records`` with description cut to its first word: headers of two words at most."""
    return records.withColumn("description", F.regexp_extract(F.trim("description"), r"^(\S*)", 1))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, ext_id)."""
    lines = spark.read.text(path).filter(F.col("value").contains(" "))
    return lines.select(F.split("value", " ", 2)[0].cast("bigint").alias("seq_id"), F.split("value", " ", 2)[1].alias("ext_id"))


def sequence_count(spark: SparkSession, path: str, frames: int = 1) -> int:
    """Number of sequences that the meta file at ``path`` states, times the frames each will have."""
    return frames * int(spark.read.text(path).filter(~F.col("value").contains(" ")).first()[0])


def base_name(records: DataFrame) -> str:
    """Name of the first source file, without folder and extension."""
    name = records.agg(F.min(F.element_at(F.split("source_file", "/"), -1))).first()[0]
    return re.sub(EXTENSIONS, "", name)


def dealt(seqs: DataFrame, file_letters: int) -> DataFrame:
    """(cluster_id, value): two-line records, dealt over tasks so that a file has about ``file_letters`` letters.

    Clusters are counted first.  The counts, a row per cluster, are sent to the sequences; if these were dealt out by cluster to meet them, all of a cluster would be in one task."""
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("seq_id").cast("string")), *(["description"] if "description" in seqs.columns else []))
    parts = seqs.groupBy("cluster_id").agg(F.ceil((F.sum(F.coalesce(F.length("seq"), F.lit(0))) + 1) / file_letters).cast("bigint").alias("_parts"))
    out = seqs.join(F.broadcast(parts), "cluster_id").select("cluster_id", F.concat(F.trim(head), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"), F.pmod(F.xxhash64("seq_id"), F.col("_parts")).alias("_part"))
    return out.repartition("cluster_id", "_part").drop("_part")


def write_partitions(seqs: DataFrame, path: str, file_letters: int = 64_000_000) -> None:
    """Two-line FASTA under ``<path>/cluster_id=<id>/``; ``seqs`` has cluster_id, seq_id, seq and maybe description.  Each cluster is dealt() over several files."""
    dealt(seqs, file_letters).write.mode("overwrite").partitionBy("cluster_id").text(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, seq_id, seq) of what write_partitions() wrote."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    value = F.regexp_replace("value", "^>", "")
    return lines.select(F.col("cluster_id").cast("bigint"), F.regexp_extract(value, r"^(\d+)", 1).cast("bigint").alias("seq_id"), F.regexp_replace(F.regexp_extract(value, r"\n([\s\S]*)$", 1), r"\n", "").alias("seq"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)
