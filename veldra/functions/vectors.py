"""Vectors as arrays of numbers; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l1_unit(a: Column) -> Column:
    """The vector over the sum of its entries; unchanged if that is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform(a, lambda x: x / total)).otherwise(a)


def product(a: Column) -> Column:
    """Product of all entries; 1 for an empty array."""
    return F.aggregate(a, F.lit(1.0), lambda s, v: s * v)


def sign_bits(a: Column, n: int = 63) -> Column:
    """Bits of a hash: bit i is 1 where entry i is positive."""
    bits = F.transform(F.slice(a, 1, n), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, v: s + v)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
