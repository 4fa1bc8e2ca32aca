"""As-of, nearest-in-time and tolerance joins without range joins over whole keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], tolerance: int | None = None) -> DataFrame:
    """``left`` with ``carry`` columns and ``right_<time>`` of the last right row at or before it, null beyond ``tolerance``.

    One shuffle: both sides are sorted together and the last right row is carried forward.
    """
    cols = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, time, *[F.col(c).alias(f"_r_{c}") for c in carry]).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    seen = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), *[f"_r_{c}" for c in carry])), ignorenulls=True).over(seen)
    out = both.withColumn("_last", last).where("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.col(time) - F.col("_last.t") <= tolerance
    return out.select(*cols, F.when(fresh, F.col("_last.t")).alias(f"right_{time}"), *[F.when(fresh, F.col(f"_last._r_{c}")).alias(c) for c in carry])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, ident: str, right_ident: str, tolerance: int) -> DataFrame:
    """``left`` with ``right_ident`` and ``distance`` of the nearest right row on either side within ``tolerance``, else null.

    Equal distances go to the smaller right id. The equi-join runs on time buckets of the tolerance's width.
    """
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(time) / tolerance) + d for d in (-1, 0, 1)])))
    b = right.select(*keys, F.col(time).alias("_t"), F.col(right_ident).alias("_id"), F.floor(F.col(time) / tolerance).alias("_b"))
    met = a.join(b, [*keys, "_b"]).withColumn("_d", F.abs(F.col(time) - F.col("_t"))).where(F.col("_d") <= tolerance)
    best = met.groupBy(ident).agg(F.min(F.struct("_d", "_id")).alias("_m"))
    return left.join(best, ident, "left").select(*left.columns, F.col("_m._id").alias(right_ident), F.col("_m._d").alias("distance"))


def within(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance: int, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) a right row of the same keys within ``tolerance``."""
    before = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(time), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, time).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, F.col(time))
    both = both.withColumn("_p", F.max(mark).over(before)).withColumn("_n", F.min(mark).over(after)).where("_side = 1")
    hit = F.coalesce(F.col(time) - F.col("_p") <= tolerance, F.lit(False)) | F.coalesce(F.col("_n") - F.col(time) <= tolerance, F.lit(False))
    return both.where(hit if how == "left_semi" else ~hit).select(*left.columns)
