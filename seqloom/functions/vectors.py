"""Presence vectors as sorted arrays of distinct hashes, and their algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(hashes: Column) -> Column:
    """Canonical vector of an array of hashes: nulls and negative ones go, sorted, distinct."""
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h >= 0)))


def with_kmer(v: Column, h: Column | int, present: bool = True) -> Column:
    one = F.array(h if isinstance(h, Column) else F.lit(h)).cast("array<bigint>")
    return F.array_sort(F.array_union(v, one)) if present else F.array_except(v, one)


def contains(v: Column, h: Column | int) -> Column:
    return F.array_contains(v, h)


def count(v: Column) -> Column:
    return F.size(v).cast("bigint")


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def intersection_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def hamming(a: Column, b: Column) -> Column:
    return count(a) + count(b) - 2 * intersection_count(a, b)


def popcount(word: Column) -> Column:
    return F.bit_count(word)


def hash_code(v: Column) -> Column:
    """XOR of the vector's 32-bit words."""
    return F.aggregate(v, F.lit(0), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1), (h % 32).cast("int"))))


def same_parameters(k_a: int, sigma_a: int, k_b: int, sigma_b: int) -> None:
    if (k_a, sigma_a) != (k_b, sigma_b):
        raise ValueError("vectors of different k-mer lengths or alphabets")
