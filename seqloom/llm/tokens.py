"""Token counts: an exact histogram of encoded lengths.

Documents are encoded in Arrow batches by a public byte-level BPE vocabulary, whose file is a
parameter, and aggregated by length.  Suffix sums over the histogram answer, for every length L: how
many documents have at least L tokens, the tokens they hold, the total when every text is cut to L
tokens, and the share of documents of at most L tokens.  The histogram has at most as many rows as
there are distinct lengths; its suffix sums are taken in blocks of 1,024 lengths and then over blocks.  A context limit is
a length that no document need have, so limits enter the histogram as rows of 0 documents and are answered alike.

Every text is encoded once, whole, whatever its length; the histogram is written out before it is used.

Defined results: null or empty text -> length 0; special tokens' strings are ordinary text; repeated
rows count each time; an empty table gives no rows but those of limits, with totals of 0 and a null share; limits below 0
or null are not answered; columns besides text are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 1024
#: Context limits that the query answers besides the lengths that occur.
LIMITS = tuple(1 << k for k in range(21))


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_of(spark, path: str):
    """Pandas UDF text -> number of tokens.  The vocabulary file, a few MB, is read by the driver and broadcast."""
    import public_tokenizers as P

    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    pattern = P.PATTERN

    @F.pandas_udf("long")
    def n_tokens(text: pd.Series) -> pd.Series:
        enc = _encoding(shared.value, pattern)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in text], dtype="int64")

    return n_tokens


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs), a row per length that occurs, written out."""
    n = length_of(docs.sparkSession, vocabulary or default_vocabulary())(F.col("text"))
    return cut(docs.select(n.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Adds docs_at_least, tokens_at_least, truncated_total (all texts cut to n_tokens) and share_at_most; with ``limits``
    (context_limit) there are rows of these lengths too."""
    if limits is not None:
        zero = limits.filter("context_limit >= 0").select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
        hist = hist.select("n_tokens", "n_docs").union(zero).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_s").over(after), F.lit(0)).alias("_s0"),
                           F.sum("_d").over(Window.partitionBy()).alias("_all"), F.sum("_s").over(Window.partitionBy()).alias("_sum"))
    own = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    j = h.withColumn("_d1", F.sum("n_docs").over(own)).withColumn("_s1", F.sum("_t").over(own)).join(blocks, "_block")
    d, s = F.col("_d0") + F.col("_d1"), F.col("_s0") + F.col("_s1")
    return j.select("n_tokens", "n_docs", d.alias("docs_at_least"), s.alias("tokens_at_least"),
                    (F.col("_sum") - s + d * F.col("n_tokens")).alias("truncated_total"),
                    F.try_divide(F.col("_all") - d + F.col("n_docs"), F.col("_all")).alias("share_at_most"))


def truncated_totals(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, total_tokens) for any limits."""
    asked = limits.select(F.col("context_limit").cast("long").alias("context_limit")).distinct()
    s = suffix_sums(hist, asked)
    return asked.join(s, F.col("context_limit") == F.col("n_tokens")).select("context_limit", F.col("truncated_total").alias("total_tokens"))


def quantile(sums: DataFrame, q: float) -> Column:
    """Aggregate over suffix_sums(): the smallest length with share_at_most >= q."""
    return F.min(F.when((F.col("share_at_most") >= q) & (F.col("n_docs") > 0), F.col("n_tokens")))
