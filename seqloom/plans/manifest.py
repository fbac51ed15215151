"""Which steps of a run have finished, and by which parameters, kept beside their results."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def finished(spark: SparkSession, out: str, steps: tuple[str, ...]) -> dict[str, dict]:
    """{step: {serial, parameters}} of the ``steps`` under ``out`` that have finished since the ones before them."""
    try:
        rows = spark.read.schema("step string, serial bigint, parameters string").json(f"{out}/manifest/*").collect()  # a row per step
    except AnalysisException:
        return {}
    found, last = {r.step: {"serial": r.serial, "parameters": r.parameters} for r in rows}, -1
    for step in steps:
        if step not in found or found[step]["serial"] < last:
            return {s: found[s] for s in steps[: steps.index(step)]}
        last = found[step]["serial"]
    return found


def record(spark: SparkSession, out: str, step: str, steps: tuple[str, ...], parameters: dict) -> None:
    """Note that ``step`` is done.  What was noted of later steps counts no longer, as its serial number is lower."""
    try:
        serial = spark.read.schema("serial bigint").json(f"{out}/manifest/*").agg({"serial": "max"}).first()[0] or 0
    except AnalysisException:
        serial = 0
    row = [(step, serial + 1, json.dumps(parameters, sort_keys=True))]
    spark.createDataFrame(row, "step string, serial bigint, parameters string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest/{step}")


def require(spark: SparkSession, out: str, start: str, steps: tuple[str, ...], parameters: dict[str, dict]) -> None:
    """Raise unless every step before ``start`` has finished, by these parameters."""
    done = finished(spark, out, steps)
    for step in steps[: steps.index(start)]:
        if step not in done:
            raise ValueError(f"can't start at {start!r}: {step!r} has not finished under {out}")
        was, now = json.loads(done[step]["parameters"]), json.loads(json.dumps(parameters[step]))
        if was != now:
            raise ValueError(f"can't start at {start!r}: {step!r} was run with {was}, not {now}")
