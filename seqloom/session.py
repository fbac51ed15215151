"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, name: str = "seqloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times; ``conf`` keys use __ for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master).config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"seqloom/{p.relative_to(root)}")
        sc.addPyFile(at)
        sc._seqloom_shipped = sc.applicationId
    return spark


def aligner_archive(spark: SparkSession) -> str:
    """A zip of the aligner in ``programs`` with what it needs, made once per application, for Spark to send to the executors."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_seqloom_aligner", ("",))[0] != sc.applicationId:
        at = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "aligner.zip")
        with zipfile.ZipFile(at, "w") as z:
            z.write(root / "programs/local_align.py", "local_align.py")
            z.write(root / "operators/waves.py", "waves.py")
        sc._seqloom_aligner = (sc.applicationId, at)
    return sc._seqloom_aligner[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/")


#: Scratch folders of the innermost settled() under way.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"
    if (made := _passing.get()) is not None:
        made.append(at)
    return at


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, whatever file system they are in; those that aren't there are passed over."""
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written to the shared folder and reread; the scratch that it wrote on the way is deleted, also if it fails."""
    made: list[str] = []
    outer, token = _passing.get(), _passing.set(made)
    try:
        df, at = make(), f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
    finally:
        _passing.reset(token)
        discard(spark, made)
    if outer is not None:
        outer.append(at)
    return spark.read.schema(df.schema).parquet(at)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there and survives lost executors."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, at: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or to ``at``) in buckets of ``key``, and reread: joins and aggregates on ``key`` need no shuffle of it."""
    spark = df.sparkSession
    n, at = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), at or scratch(spark, name)
    table = f"seqloom_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", at).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def open_bucketed(spark: SparkSession, at: str, columns: str, key: str, buckets: int) -> DataFrame:
    """What bucketed() wrote to ``at``, also in another session."""
    table = f"seqloom_opened_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(table)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores; only a scan of fewer splits than cores, which would leave some idle, is dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
