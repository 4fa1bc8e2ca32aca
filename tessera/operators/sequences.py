"""State machines and run-length operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(df: DataFrame, keys: list[str], order: list[str], side: str) -> DataFrame:
    """Adds ``state`` (the last side that isn't null) and ``crossing`` (it differs from a known state before)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    carried = df.withColumn("state", F.last(side, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return carried.withColumn("crossing", F.coalesce(F.lag("state").over(w) != F.col("state"), F.lit(False)))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, first: Column, last: Column) -> DataFrame:
    """Runs of equal values: (keys, run, value, first, last, n); rows with a null value are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(value).isNotNull())
    change = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    numbered = known.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("n"))


def debounce(df: DataFrame, keys: list[str], time: str, vote: str, width: int, share: float, votes: int) -> DataFrame:
    """Adds ``state``: 1 when at least ``share`` of the votes of the last ``width`` are 1, 0 when at most 1 - share; else carried.

    Windows with fewer than ``votes`` votes decide nothing.
    """
    past = Window.partitionBy(*keys).orderBy(time).rangeBetween(-width, 0)
    seen = df.withColumn("_n", F.count(vote).over(past)).withColumn("_ones", F.sum(vote).over(past))
    # in tenths, so that the gates are exact
    up, tenths = F.col("_ones") * 10 >= F.col("_n") * round(share * 10), F.col("_n") >= votes
    down = F.col("_ones") * 10 <= F.col("_n") * (10 - round(share * 10))
    now = F.when(tenths & up, 1).when(tenths & down, 0)
    return seen.withColumn("state", F.last(now, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, 0))).drop("_n", "_ones")


def majority(df: DataFrame, keys: list[str], order: list[str], code: str, classes: list[int], reach: int) -> DataFrame:
    """Adds ``smooth``: the commonest class within ``reach`` rows, the lowest on ties."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    counts = [F.count_if(F.col(code) == c).over(w) for c in classes]
    top = F.greatest(*counts)
    return df.withColumn("smooth", F.coalesce(*[F.when(n == top, F.lit(c)) for c, n in zip(classes, counts, strict=True)]))


def median5(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``median5``: the median of five rows around each, with zeros beyond both ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = [F.lag(value, k, 0.0).over(w) for k in (2, 1)] + [F.col(value)] + [F.lead(value, k, 0.0).over(w) for k in (1, 2)]
    return df.withColumn("median5", F.get(F.array_sort(F.array(*near)), F.lit(2)))


def window_jump(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Adds ``before`` and ``after``: means of the ``width`` rows before and from here on, null where there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    full = lambda span: F.when(F.count(value).over(span) == width, F.sum(value).over(span) / width)
    return df.withColumn("before", full(back)).withColumn("after", full(ahead))


def switches(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, rows, switches): changes of the value between consecutive rows; nulls are skipped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(value).isNotNull())
    return known.withColumn("_s", (F.lag(value).over(w) != F.col(value)).cast("int")).groupBy(*keys).agg(F.count("*").alias("rows"), F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"))


def gap_fill(df: DataFrame, keys: list[str], slot: str, value: str, longest: int) -> DataFrame:
    """A row for every slot between neighbours at most ``longest`` apart, linearly interpolated: (keys, slot, value, filled)."""
    w = Window.partitionBy(*keys).orderBy(slot)
    step = F.lead(slot).over(w) - F.col(slot)
    pair = df.withColumn("_n", F.when(step <= longest, step).otherwise(1)).withColumn("_v", F.lead(value).over(w))
    out = pair.withColumn("_k", F.explode(F.expr("sequence(0L, coalesce(_n, 1) - 1)")))
    lerp = F.when(F.col("_k") == 0, F.col(value)).otherwise(F.col(value) + (F.col("_v") - F.col(value)) * F.col("_k") / F.col("_n"))
    return out.select(*keys, (F.col(slot) + F.col("_k")).alias(slot), lerp.alias(value), (F.col("_k") > 0).alias("filled"))
