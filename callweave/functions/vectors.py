"""Arithmetic on embedding columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY_NORM = 1e-8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length < TINY_NORM, F.transform(a, lambda x: F.lit(0.0))).otherwise(
        F.transform(a, lambda x: x / length)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a vector without length is at distance 1 from everything."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY_NORM) | (nb < TINY_NORM), F.lit(1.0)).otherwise(
        1.0 - dot(a, b) / (na * nb)
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > TINY_NORM, dot(a, b) / length).otherwise(F.lit(0.0))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
