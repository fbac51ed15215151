"""A training-corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, removal
of personal data, and mixing by a curriculum.  Each stage works on what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontam, jaccard, mixing, pii, quality
from seqloom.llm.common import cut, table
from seqloom.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and blank texts fail; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.  Exactly one row of a group stays, also where
    ids are null or repeated; texts without words are linked with nothing and all stay."""
    ship(spark)
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.  Null and empty texts have none and stay, as all do if the benchmark is empty."""
    return decontam.remove_contaminated(docs, table(ship(spark), sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.  Null texts stay null; overlapping spans are merged."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned documents in training order: all their columns, the words taken and the positions.  Columns named as one
    that the mix adds are replaced; rows with null or repeated ids stay; a null text has size 0 and comes last."""
    return mixing.training_order(mixing.curriculum(docs, carry=docs.columns))


STAGES = [("quality rules", quality_stage), ("near duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("personal data", personal_data_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
