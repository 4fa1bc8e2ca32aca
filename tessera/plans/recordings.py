"""Recordings as tables: the event log stands in for a camera's frames and for a recorder's tick files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frame_clock
from ..operators.scratch import shared_dir
from ..sources import events
from ..sources.ticks import read_ticks
from .event_sequences import DAY, EV, HOUR, MINUTE

#: A camera is 40 users, a segment two hours, a frame an event; the nominal rate is one frame in ten minutes.
CAMS, SEG, STEP, WANTED = 40, 2 * HOUR, 10 * MINUTE, 40


def frame_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true time of 40 frames of each clip; a clip begins 25 minutes into a segment and runs on into the next ones."""
    log = events(spark, sf_dir).selectExpr("event_id", f"user_id div {CAMS} AS cam", "us", f"us div {SEG} AS seg")
    w = Window.partitionBy("cam", "seg").orderBy("us", "event_id")
    frames = log.select("cam", "seg", (F.row_number().over(w) - 1).alias("k"), (F.col("us") - F.col("seg") * SEG).alias("off"))
    segments = log.select("cam", "seg", (F.col("seg") * SEG).alias("start")).distinct()
    clips = segments.select(F.expr("cam * 10000000 + seg").alias("clip"), "cam", (F.col("start") + 25 * MINUTE).alias("start"), F.lit(None).cast("bigint").alias("landed"))
    wanted = clips.select("clip", F.explode(F.sequence(F.lit(0), F.lit(WANTED - 1))).alias("k"))
    return frame_clock.walls(segments, frames, clips, wanted, SEG, STEP)


WALLS_SQL = f"""WITH {EV}, l AS (SELECT user_id // {CAMS} AS cam, us, us // {SEG} AS seg, row_number() OVER (PARTITION BY user_id // {CAMS} ORDER BY us, event_id) - 1 AS number FROM ev),
c AS (SELECT cam, seg, min(number) + 2 AS begin FROM l GROUP BY cam, seg), w AS (SELECT cam * 10000000 + seg AS clip, cam, begin, unnest(range({WANTED}))::INT AS k FROM c)
SELECT clip, k, l.us AS wall FROM w LEFT JOIN l ON l.cam = w.cam AND l.number = w.begin + w.k"""


def tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as a recorder does, a gzip file a day with stretches of an hour, and read back; of odd days the last stretch isn't finished."""
    log = events(spark, sf_dir).selectExpr("event_id", "user_id", "value", f"us div {DAY} AS day", f"us % {DAY} div {HOUR} AS s", f"us % {DAY} / 1000000 AS t")
    lines = log.select("day", F.lit(1).alias("part"), "s", "t", "event_id", F.to_json(F.struct("s", "t", F.array(F.struct(F.col("user_id").alias("w"), F.col("value").alias("v"), "event_id")).alias("p"))).alias("value"))
    spans = log.groupBy("day").agg(F.countDistinct("s").alias("n")).withColumn("n", F.col("n") + F.col("day") % 2)
    head = spans.select("day", F.lit(0).alias("part"), F.to_json(F.struct("day", F.expr("transform(sequence(1, CAST(n AS INT)), k -> array(k, k + 1))").alias("spans"))).alias("value"))
    folder = f"{shared_dir(spark)}/ticks-{uuid.uuid4().hex}"
    whole = lines.unionByName(head, allowMissingColumns=True).repartition("day").sortWithinPartitions("day", "part", "s", "t", "event_id").select("day", "value")
    whole.write.partitionBy("day").option("compression", "gzip").text(folder)
    seen = read_ticks(spark, folder).select("s", F.explode(F.from_json("line", "p array<struct<w: bigint, v: double, event_id: bigint>>")["p"]).alias("p"))
    return seen.select("s", F.col("p.w").alias("who"), F.col("p.event_id").alias("event_id"), F.col("p.v").alias("v"))


TICKS_SQL = f"""WITH {EV}, l AS (SELECT *, us // {DAY} AS day, us % {DAY} // {HOUR} AS s FROM ev)
SELECT s, user_id AS who, event_id, value AS v FROM l WHERE day % 2 = 0 OR s < (SELECT max(s) FROM l x WHERE x.day = l.day)"""

QUERIES = {"frame_walls": (frame_walls, WALLS_SQL), "tick_rows": (tick_rows, TICKS_SQL)}
