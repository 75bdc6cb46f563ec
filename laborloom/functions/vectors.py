"""Vectors in arrays, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZERO = lambda: F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _ZERO(), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length one, or as it is where it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def parse_vector(text: Column) -> Column:
    """A vector written as a JSON list of numbers; null where it is no such list."""
    return F.from_json(text, "array<double>")


def of_length(a: Column, n: int) -> Column:
    """The vector, or null where it hasn't `n` numbers."""
    return F.when(F.size(a) == n, a)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, n): the mean of each key's vectors, number by number."""
    long = df.select(key, F.posexplode(vector).alias("pos", "x"))
    mean = long.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))
