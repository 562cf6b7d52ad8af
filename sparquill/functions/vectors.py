"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sum_of


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(sum_of(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def likeness(a: Column, b: Column, metric: str) -> Column:
    """Cosine and dot product as they are, distances as 1 / (1 + distance)."""
    if metric in ("euclidean", "manhattan"):
        return 1 / (1 + {"euclidean": euclidean, "manhattan": manhattan}[metric](a, b))
    return {"cosine": cosine, "dot": dot}[metric](a, b)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def weighted(vectors: list[Column], weights: list[float]) -> Column:
    """The weighted sum, place by place."""
    out = F.transform(vectors[0], lambda x: x * float(weights[0]))
    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = _plus(out, v, float(w))
    return out


def _plus(a: Column, b: Column, w: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * w)


def mean_of(vectors: list[Column]) -> Column:
    return F.transform(weighted(vectors, [1.0] * len(vectors)), lambda x: x / float(len(vectors)))


def joined(vectors: list[Column], size: int) -> Column:
    """One behind the other, cut or filled with zeros to the size."""
    return F.slice(F.concat(*vectors, F.array_repeat(F.lit(0.0), size)), 1, size)


def attended(text: Column, others: list[Column]) -> Column:
    """The text's vector and each other one by the sigmoid of their scaled dot product."""
    out = text
    for v in others:
        out = _plus(out, v, 1 / (1 + F.exp(-dot(text, v) / F.sqrt(F.size(text)))))
    return out


def mock_vector(text: Column, size: int) -> Column:
    """A stand-in by length: sin(bytes + i) / (i + 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sin((F.octet_length(text) + i).cast("double")) / (i + 1))


def length_vector(text: Column, size: int) -> Column:
    """A stand-in by length: (31 bytes + 17 i) modulo 1000, over 1000."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((F.octet_length(text) * 31 + i * 17) % 1000) / 1000.0)
