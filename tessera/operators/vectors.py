"""Similarity of embedding columns in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A double vector of length 1; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, vector, n): the element-wise mean; partial sums are combined map-side."""
    flat = df.select(*keys, F.posexplode(vector).alias("_k", "_x")).groupBy(*keys, "_k").agg(F.avg("_x").alias("_x"), F.count("*").alias("n"))
    packed = flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_x"))).alias("_v"), F.max("n").alias("n"))  # one element per dimension
    return packed.select(*keys, F.transform("_v", lambda s: s["_x"]).alias(vector), "n")
