"""Vector functions over array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusegrid.functions.scalar import bound


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def normalise(a: Column) -> Column:
    def scaled(v: Column) -> Column:
        return bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return bound(doubles(a), scaled)


def hash_embedding(text: Column, size: int = 1536, chunk: int = 64) -> Column:
    """Deterministic unit vector of a text: 60 bits of an MD5 a chunk, counted up within it, modulo 10,000, from -1 to 1."""
    seed = lambda h, c: F.conv(F.substring(F.md5(F.concat(h, F.lit(":"), c.cast("string"))), 1, 15), 16, 10).cast("long")
    within = lambda s: F.transform(F.sequence(F.lit(0), F.lit(chunk - 1)), lambda j: (s + j) % F.lit(10000) / F.lit(5000.0) - F.lit(1.0))
    chunks = lambda h: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-size // chunk) - 1)), lambda c: bound(seed(h, c), within)))
    return normalise(F.slice(bound(F.md5(text), chunks), 1, size))  # the text is read once
