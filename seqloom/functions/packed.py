"""Presence vectors as 64-bit words, with the k-mer length and alphabet size they were made by.

A packed vector is a struct (k, sigma, words); hash h is bit h mod 64 of word h div 64.  Every operator of two vectors checks that both were made
alike and raises an error where they weren't.  Words are combined by built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<k:int,sigma:int,words:array<bigint>>"


def n_words(k: int, sigma: int, base: int | None = None) -> int:
    """Words for all hashes of ``k``-mers over ``sigma`` letters; positions weigh powers of ``base``, k by default."""
    return (sum((sigma - 1) * (base or k) ** i for i in range(k)) + 64) // 64


def pack(long_form: DataFrame, k: int, sigma: int, base: int | None = None, key: str = "seq_id") -> DataFrame:
    """(key, v) of vectors in long form (key, h).  Bits of a word are merged before they are shuffled; hashes out of range raise an error."""
    size = n_words(k, sigma, base)
    h = F.when((F.col("h") >= 0) & (F.col("h") < 64 * size), F.col("h")).otherwise(F.raise_error(F.concat(F.lit("hash out of range: "), F.col("h").cast("string"))).cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    words = long_form.select(key, F.floor(F.col("h") / 64).alias("_w"), bit.alias("_b")).groupBy(key, "_w").agg(F.bit_or("_b").alias("_b"))
    held = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")), lambda w: F.coalesce(F.col("_m")[w], F.lit(0).cast("bigint")))
    return held.select(key, F.struct(F.lit(k).alias("k"), F.lit(sigma).alias("sigma"), every.alias("words")).alias("v"))


def hashes(v: Column) -> Column:
    """Sorted array of the hashes."""
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(v["words"], lambda w, i: F.transform(F.filter(bits, lambda b: F.call_function("getbit", w, b) == 1), lambda b: i.cast("bigint") * 64 + b)))


def empty_like(v: Column) -> Column:
    return F.struct(v["k"].alias("k"), v["sigma"].alias("sigma"), F.transform(v["words"], lambda w: F.lit(0).cast("bigint")).alias("words"))


def _alike(a: Column, b: Column) -> Column:
    """The words of ``b``, or an error if it was made unlike ``a``."""
    same = (a["k"] == b["k"]) & (a["sigma"] == b["sigma"]) & (F.size(a["words"]) == F.size(b["words"]))
    said = F.raise_error(F.lit("vectors of different k-mer lengths or alphabets"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(same, b["words"]).otherwise(said.cast("array<bigint>"))


def _combined(a: Column, b: Column, of) -> Column:
    return F.struct(a["k"].alias("k"), a["sigma"].alias("sigma"), F.zip_with(a["words"], _alike(a, b), of).alias("words"))


def _summed(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def union(a: Column, b: Column) -> Column:
    return _combined(a, b, lambda x, y: x.bitwiseOR(y))


def intersection(a: Column, b: Column) -> Column:
    return _combined(a, b, lambda x, y: x.bitwiseAND(y))


def count(v: Column) -> Column:
    return _summed(v["words"])


def intersection_count(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(a["words"], _alike(a, b), lambda x, y: x.bitwiseAND(y)))


def hamming(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(a["words"], _alike(a, b), lambda x, y: x.bitwiseXOR(y)))


def intersects(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a["words"], _alike(a, b), lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def contains(v: Column, h: Column | int) -> Column:
    """Whether ``h`` is in the vector; false beyond its words."""
    h = h if isinstance(h, Column) else F.lit(h)
    word = F.get(v["words"], F.floor(h / 64).cast("int"))
    return F.coalesce(F.call_function("getbit", word, (h % 64).cast("int")) == 1, F.lit(False))


def with_kmer(v: Column, h: Column | int, present: bool = True) -> Column:
    """The vector with bit ``h`` set or cleared."""
    h = h if isinstance(h, Column) else F.lit(h)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    change = (lambda w: w.bitwiseOR(bit)) if present else (lambda w: w.bitwiseAND(F.bitwise_not(bit)))
    words = F.transform(v["words"], lambda w, i: F.when(i == F.floor(h / 64), change(w)).otherwise(w))
    return F.struct(v["k"].alias("k"), v["sigma"].alias("sigma"), words.alias("words"))


def merged(vectors: DataFrame, key: str, column: str = "v") -> DataFrame:
    """(key, v): union of the vectors of each key, by words; vectors of a key made unlike each other raise an error."""
    w = vectors.select(key, F.col(f"{column}.k").alias("_k"), F.col(f"{column}.sigma").alias("_s"), F.posexplode(f"{column}.words").alias("_i", "_b"))
    w = w.groupBy(key, "_i").agg(F.bit_or("_b").alias("_b"), F.min("_k").alias("_k"), F.max("_k").alias("_k1"), F.min("_s").alias("_s"), F.max("_s").alias("_s1"))
    held = w.groupBy(key).agg(F.min("_k").alias("k"), F.max("_k1").alias("_k1"), F.min("_s").alias("sigma"), F.max("_s1").alias("_s1"), F.array_sort(F.collect_list(F.struct("_i", "_b"))).alias("_w"))
    words = F.when((F.col("k") == F.col("_k1")) & (F.col("sigma") == F.col("_s1")), F.transform("_w", lambda x: x["_b"])).otherwise(F.raise_error(F.lit("vectors of different k-mer lengths or alphabets")).cast("array<bigint>"))
    return held.select(key, F.struct("k", "sigma", words.alias("words")).alias(column))
