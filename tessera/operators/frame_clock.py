"""True times of a recording's frames: numbered through all segments of a camera, so that a clip's frame is one equality join away.

A clip counts its frames at a nominal rate, but a camera drops frames without leaving a gap in the count. What a frame shows is
at the time that the recording has for it, and a clip runs on into the segments that follow with as many frames as they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def disordered(frames: DataFrame) -> DataFrame:
    """(cam, seg) of segments whose times go backwards."""
    before = F.lag("off").over(Window.partitionBy("cam", "seg").orderBy("k"))
    return frames.withColumn("_before", before).where("off < _before").select("cam", "seg").distinct()


def numbered(segments: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with ``base``, the number of their first frame, and frames as (cam, number, wall).

    ``segments``: (cam, seg, start); ``frames``: (cam, seg, k from 0, off: time after the segment's start). Segments whose times
    go backwards count with their frames, but have no times.
    """
    counts = frames.groupBy("cam", "seg").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cam").orderBy("start", "seg").rowsBetween(Window.unboundedPreceding, -1)  # segments, not frames
    known = segments.join(counts, ["cam", "seg"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    known = cut(known, "clock-segments")
    good = known.join(disordered(frames), ["cam", "seg"], "left_anti")
    return known, frames.join(good, ["cam", "seg"]).select("cam", (F.col("base") + F.col("k")).alias("number"), (F.col("start") + F.col("off")).alias("wall"))


def walls(segments: DataFrame, frames: DataFrame, clips: DataFrame, wanted: DataFrame, length: int, step: int) -> DataFrame:
    """(clip, k, wall) for every wanted frame; null where nothing was recorded.

    ``clips``: (clip, cam, start, landed); ``wanted``: (clip, k). A clip begins in the first segment that covers its start, which
    is shorter than ``length``: at the frame it landed on, or where landed is null at the nearest by the nominal ``step`` of time.
    """
    known, clock = numbered(segments, frames)
    slot = lambda c: F.floor(F.col(c) / length)
    near = known.select("cam", F.col("start").alias("_s"), "seg", "base", F.explode(F.array(slot("start"), slot("start") + 1)).alias("_slot"))
    met = clips.withColumn("_slot", slot("start")).join(near, ["cam", "_slot"]).where((F.col("_s") <= F.col("start")) & (F.col("start") < F.col("_s") + length))
    first = met.groupBy("clip", "cam").agg(F.min(F.struct("_s", "seg", "base", "start", "landed")).alias("f"))
    begin = F.coalesce(F.col("f.landed"), F.rint((F.col("f.start") - F.col("f._s")) / step).cast("bigint"))
    begun = first.select("clip", "cam", (F.col("f.base") + begin).alias("begin"))
    asked = wanted.join(begun, "clip", "left").withColumn("number", F.col("begin") + F.col("k"))
    return asked.join(clock, ["cam", "number"], "left").select("clip", "k", "wall")


def drift(found: DataFrame, step: int) -> DataFrame:
    """(clip, last, largest): how much later than counted the frames of ``walls`` are at the clip's end and at most, from its frame 0 on."""
    seen = found.where("wall is not null")
    zero = seen.where("k = 0").select("clip", F.col("wall").alias("_zero"))
    behind = seen.join(zero, "clip").withColumn("behind", F.col("wall") - F.col("_zero") - F.col("k") * step)
    return behind.groupBy("clip").agg(F.max_by("behind", "k").alias("last"), F.max(F.abs("behind")).alias("largest"))
