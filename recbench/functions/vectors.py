"""Vectors as ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    """Sum of the components."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null where a norm is zero. Norms computed before are used as they are."""
    return F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def not_zero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def vector_sum(v: Column) -> Column:
    """Aggregate: element-wise sum. Partial sums are one vector for each task and group."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def vector_max(v: Column) -> Column:
    """Aggregate: element-wise maximum."""
    return vector_to_array(Summarizer.max(array_to_vector(v)))


def min_max(v: Column) -> Column:
    """Components rescaled to 0..1; all 0 if they are equal."""
    low, high = F.array_min(v), F.array_max(v)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.transform(v, lambda x: (x - low) / span)


def one_hot(value: Column, vocabulary: list) -> Column:
    return F.array(*[F.coalesce((value == F.lit(x)).cast("double"), F.lit(0.0)) for x in vocabulary])


def multi_hot(values: Column, vocabulary: Column) -> Column:
    """1 where a vocabulary entry is among values."""
    return F.transform(vocabulary, lambda t: F.coalesce(F.array_contains(values, t).cast("double"), F.lit(0.0)))


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def presence(*columns: str) -> Column:
    """1 for each column that holds a value."""
    return F.array(*[F.col(c).isNotNull().cast("double") for c in columns])
