"""Joins whose left side may hold a large share of its rows under a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this part of the rows; there are no more than its reciprocal of them.
SHARE = 1e-3
_BUCKETS = 1 << 16


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> list:
    """The keys with at least ``share`` of the rows (nulls aside), exactly, at most 1 / ``share`` of them.

    A heavy key makes its hash bucket heavy, so exact counts are needed in heavy buckets alone; both passes combine before
    they shuffle.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    rows = rows.select(key).where(F.col(key).isNotNull())
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    counts = {r["b"]: r["n"] for r in counts.collect()}  # at most _BUCKETS rows
    least = max(2.0, share * sum(counts.values()))
    full = sorted(b for b, n in counts.items() if n >= least)
    if not full:
        return []
    spark = rows.sparkSession
    inside = rows.withColumn("b", bucket).join(F.broadcast(spark.createDataFrame([(b,) for b in full], "b bigint")), "b")  # at most 1 / share rows
    return sorted(r[key] for r in inside.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).collect())


def skewed_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (a row for each key at most; how: inner or left) where ``heavy`` keys fill much of ``left``.

    Rows of heavy keys stay where they are and get their right row by broadcast, which is bounded by the number of heavy
    keys; all others are joined by a shuffle.
    """
    if not heavy:
        return left.join(right, key, how)
    few = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in heavy], f"`{key}` {left.schema[key].dataType.simpleString()}"))
    hot = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return hot.unionByName(left.join(few, key, "left_anti").join(right, key, how))
