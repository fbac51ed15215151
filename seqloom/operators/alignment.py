"""Pairwise alignment scores and distances.

The columns that with_global() and with_local() add are computed for many pairs at once, see waves.py, which has the functions of a
single pair too.
Letters score ``match`` or ``mismatch``, or what a ScoringMatrix gives; pairs that it lacks score as without one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import ScoringMatrix
from .waves import EXTEND, GAP, MATCH, MISMATCH, global_score, local_score, scores  # noqa: F401

LOCAL_SCALE, GLOBAL_SCALE = 10_000, 30


def score_table(matrix: ScoringMatrix, match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """Scores by letter codes, both cases alike; the last row and column stand for letters beyond ASCII."""
    t = np.where(np.eye(129, dtype=bool), match, mismatch).astype(np.int64)
    t[128, 128] = mismatch
    for a, b, s in matrix.rows():
        for x in {a, a.lower()}:
            for y in {b, b.lower()}:
                t[ord(x), ord(y)] = t[ord(y), ord(x)] = s
    return t


def global_score_column(a: Column, b: Column, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> Column:
    """The same with built-in functions only, for short sequences."""
    border = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: (j * gap).cast("bigint"))

    def next_row(row: Column, i: Column) -> Column:
        c = a.substr(i, F.lit(1))
        start = F.array((i * gap).cast("bigint"))
        return F.aggregate(F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>")), start, lambda out, j: F.concat(out, F.array(F.greatest(
            F.get(row, j - 1) + F.when(c == b.substr(j, F.lit(1)), match).otherwise(mismatch), F.get(row, j) + gap, F.element_at(out, -1) + gap).cast("bigint"))))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rows, border, next_row, lambda row: F.element_at(row, -1))


def _udf(local: bool, **costs):
    @F.pandas_udf("bigint")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scores(a.fillna("").tolist(), b.fillna("").tolist(), local, **costs), dtype="int64")

    return scored


def max_length(a: str, b: str) -> Column:
    return F.least(*[F.coalesce(F.length(x), F.lit(0)) for x in (a, b)]).cast("bigint")


def with_global(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, matrix: ScoringMatrix | None = None) -> DataFrame:
    """Adds score, distance (normalised by the match value), distance_ref (normalised by the score itself) and max_length, the
    most columns of letters that an alignment can have."""
    table = matrix and score_table(matrix, match, mismatch)
    p = pairs.withColumn("score", _udf(False, match=match, mismatch=mismatch, gap=gap, table=table)(a, b))
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    d = lambda m: F.when(both > 0, F.call_function("div", GLOBAL_SCALE * (m * short - F.col("score")), both)).otherwise(0).cast("bigint")
    return p.withColumn("distance", d(F.lit(match))).withColumn("distance_ref", d(F.col("score"))).withColumn("max_length", max_length(a, b))


def with_local(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, extend: int = EXTEND, matrix: ScoringMatrix | None = None) -> DataFrame:
    """Adds score, distance and max_length."""
    table = matrix and score_table(matrix, match, mismatch)
    p = pairs.withColumn("score", _udf(True, match=match, mismatch=mismatch, gap=gap, extend=extend, table=table)(a, b))
    distance = F.call_function("div", F.lit(LOCAL_SCALE).cast("bigint"), F.col("score") + 1).cast("bigint")
    return p.withColumn("distance", distance).withColumn("max_length", max_length(a, b))
