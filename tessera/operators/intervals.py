"""Unions, sessions, overlaps and coverage of time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 0, ties: list[str] | None = None) -> DataFrame:
    """Adds ``island``: intervals of a key that touch, or lie within ``slack`` of each other, share a number."""
    order = [start, end, *(ties or [])]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    new = F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """The union of each key's intervals: (keys, start, end, n)."""
    return islands(df, keys, start, end, slack).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def sessions(df: DataFrame, keys: list[str], time: str, gap: int, *aggregates: Column) -> DataFrame:
    """Runs of rows whose time steps are at most ``gap``: (keys, start, end, n, aggregates)."""
    same = df.withColumn("_end", F.col(time))
    return islands(same, keys, time, "_end", gap).groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), *aggregates).drop("island")


def cut_blocks(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Intervals cut into pieces of at most ``size``."""
    steps = F.expr(f"sequence({start}, greatest({start}, {end} - 1), {size}L)")
    return df.withColumn("_at", F.explode(steps)).withColumn(end, F.least(F.col("_at") + size, F.col(end))).withColumn(start, F.col("_at")).drop("_at")


def bucketed_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lspan: tuple[str, str], rspan: tuple[str, str], size: int) -> DataFrame:
    """Pairs of intervals of the same keys that overlap or touch, as an equi-join on time buckets of ``size``.

    Column names of the two sides must differ but for the keys. A pair is emitted once, in the bucket where the later of
    the two begins; a key with many rows is spread over its buckets.
    """
    bucket = lambda span: F.explode(F.expr(f"sequence(floor({span[0]} / {size}), floor({span[1]} / {size}))"))
    a = left.withColumn("_bucket", bucket(lspan))
    b = right.withColumn("_bucket", bucket(rspan))
    joined = a.join(b, [*keys, "_bucket"]).where((F.col(lspan[0]) <= F.col(rspan[1])) & (F.col(rspan[0]) <= F.col(lspan[1])))
    return joined.where(F.col("_bucket") == F.floor(F.greatest(lspan[0], rspan[0]) / size)).drop("_bucket")
