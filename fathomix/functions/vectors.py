"""Column functions on vectors, in double arithmetic, and hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """v over its length plus EPSILON; v is array<double>. The length is an outer variable, computed once."""
    return F.element_at(F.transform(F.array(norm(v) + EPSILON), lambda length: F.transform(v, lambda x: x / length)), 1)


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine of a column with a fixed vector, normalised here, once."""
    length = sum(x * x for x in query) ** 0.5 + EPSILON
    literal = F.array(*(F.lit(float(x) / length) for x in query))
    return dot(v, literal) / (norm(v) + EPSILON)
