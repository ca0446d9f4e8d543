"""Vector kernels over ``array<double>`` columns, and the vector sum aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero.  Squared norms can be given, so that they are worked out once per row."""
    na, nb = norm_a if norm_a is not None else squared_norm(a), norm_b if norm_b is not None else squared_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(na * nb))


def shifted_cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return cosine(a, b, norm_a, norm_b) + F.lit(1.0)


def mean(vectors: Column) -> Column:
    """The mean of an array of vectors of equal length; null for an empty array."""
    total = F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def vector_sum(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Element-wise sums of ``columns`` by ``keys``, with partial sums before the shuffle."""
    cells = df.select(*keys, F.posexplode(F.arrays_zip(*(F.col(c) for c in columns))).alias("__i", "__v"))
    sums = cells.groupBy(*keys, "__i").agg(*(F.sum(F.col("__v")[c]).alias(c) for c in columns))
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", *columns))).alias("__r"))
    return rows.select(*keys, *(F.col("__r")[c].alias(c) for c in columns))
