"""Routing a stream of queries against static centers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import route


def read_queries(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of (query_id, seq) from Parquet files that arrive in ``path``."""
    return spark.readStream.schema("query_id bigint, seq string").option("maxFilesPerTrigger", max_files).parquet(path)


def route_stream(queries: DataFrame, centers: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Routes every micro-batch and appends to Parquet in ``out``; a query's k-mers come in one row, so batches are independent
    and a batch that is run again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        route(batch, centers, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
