"""array<double> columns as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine_similarity(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric!r}")


def mean_vectors(vectors: DataFrame, by: list[str], column: str = "vector") -> DataFrame:
    """by..., centroid: the mean vector of each group, summed by dimension before the shuffle."""
    long = vectors.select(*by, F.posexplode(column).alias("dim", "x"))
    means = long.groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    # a group has one row for each dimension here, so the list is as long as a vector
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))
