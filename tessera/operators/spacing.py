"""Keeping the first of moments that lie close, where "close" is to the last one kept.

Whether a moment is kept depends on all before it, but the next kept one depends on a kept one alone: it is the first moment
more than the gap later. So the kept moments are those met by following these pointers from the first, and doubling the
pointers finds them in as many joins as the length of a run has binary digits, instead of one walk along it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands
from .scratch import cut


def next_after(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """(``keys``, ``time``, next): the first of the key's times that is more than ``gap`` later, by one sorted merge of times and goals."""
    both = df.select(*keys, F.col(time).alias("_at"), F.col(time).alias("_time"), F.lit(None).cast("bigint").alias("_goal")).unionByName(
        df.select(*keys, (F.col(time) + gap + 1).alias("_at"), F.lit(None).cast("bigint").alias("_time"), F.col(time).alias("_goal"))
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_time").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("next", F.last("_time", ignorenulls=True).over(w))
    return met.where("_goal is not null").select(*keys, F.col("_goal").alias(time), "next")


def first_of_close(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """(``keys``, ``time``) of the moments that stay: a key's first, then each that is more than ``gap`` after the last one that stayed.

    Times are whole numbers; repeated moments count once, null times are ignored. A moment more than ``gap`` after its
    predecessor always stays, so pointers end at such gaps, and only runs between them need rounds.
    """
    runs = df.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    runs = islands(runs.withColumn("_end", F.col(time)), keys, time, "_end", gap).drop("_end")
    own = [*keys, "island"]
    jumps = cut(next_after(runs, own, time, gap).withColumnRenamed("next", "to"), "spacing-jump-0")
    levels, k = [jumps], 0
    while not (jumps := jumps.where("to is not null")).isEmpty():
        k += 1
        onward = levels[-1].select(*own, F.col(time).alias("to"), F.col("to").alias("further"))
        jumps = cut(jumps.join(onward, [*own, "to"]).select(*own, time, F.col("further").alias("to")), f"spacing-jump-{k}")
        levels.append(jumps)
    kept = runs.groupBy(*own).agg(F.min(time).alias(time))
    for level in reversed(levels):
        kept = cut(kept.unionByName(kept.join(level.where("to is not null"), [*own, time]).select(*own, F.col("to").alias(time))), "spacing-kept")
    return kept.select(*keys, time)
