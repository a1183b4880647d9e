"""Vectors as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for different lengths or a zero vector."""
    n_a, n_b = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n_a > 0) & (n_b > 0), dot(a, b) / (n_a * n_b))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The offline embedder: unit vector of the bytes of the text's SHA-256."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    raw = _let(F.sha2(text, 256), lambda h: F.transform(places, lambda j: F.conv(F.substr(h, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1))
    return _let(raw, lambda r: _let(F.sqrt(dot(r, r)), lambda n: F.transform(r, lambda x: x / n)))


def serialised(v: Column) -> Column:
    """A vector as JSON without spaces; null stays null."""
    return F.to_json(v.cast("array<double>"))


def deserialised(c: Column) -> Column:
    """The vector of a JSON text; null for a null or empty one. Malformed text raises."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.from_json(c, "array<double>", {"mode": "FAILFAST"}))


def normalised(v: Column) -> Column:
    """A vector at unit length; a zero vector stays as it is."""
    return _let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
