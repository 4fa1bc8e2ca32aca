"""Masks and boxes over the event log: a shop of 50 users is a camera, an event a detection, three hours a moment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks
from ..operators.scratch import cut
from ..sources import events
from .event_sequences import EV, HOUR

SHOP, CELL = 50, 16
_SHAPE = {
    "cam": f"user_id DIV {SHOP}", "frame": f"us DIV {3 * HOUR}", "x0": "event_id * 7 % 40", "y0": "event_id * 11 % 30", "w": "6 + CAST(round(value * 100) AS BIGINT) % 12", "h": "8 + user_id % 14",
}
#: Chunks of 12 hours and three more that the next one shows too.
CHUNK, SHARED = 12 * HOUR, 3 * HOUR


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, us, cam, frame, x0, y0, x1, y1)."""
    log = events(spark, sf_dir).selectExpr("event_id", "user_id", "us", *[f"CAST({e} AS BIGINT) AS {n}" for n, e in _SHAPE.items()])
    return log.selectExpr("event_id", "user_id", "us", "cam", "frame", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")


def with_ellipses(df: DataFrame) -> DataFrame:
    """``df`` with ``mask``: the ellipse in each box, in whole numbers. All of a size are one mask, drawn once a task."""

    def ellipse(w: int, h: int) -> bytes:
        x, y = (2 * np.arange(w) + 1 - w) * h, (2 * np.arange(h) + 1 - h) * w
        return masks.pack(x[None] ** 2 + y[:, None] ** 2 <= (w * h) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = lru_cache(4096)(ellipse)
        for b in batches:
            x0, y0, x1, y1 = (b.column(c).to_pylist() for c in masks.BOX)
            out = [drawn(v - t, w - u) for t, u, v, w in zip(x0, y0, x1, y1, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.binary())], names=[*b.schema.names, "mask"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", mask binary")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt to all tasks: the log's few files would leave the pairing, too, to a few
    shown = cut(with_ellipses(detections(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cam", "frame")), "masks")
    met = masks.overlapping(shown, masks.other(shown, ["cam", "frame"]), ["cam", "frame"], CELL).where("event_id < event_idr")
    return masks.mask_overlap(met, ["event_id", "event_idr"]).where("inter > 0").select(F.col("event_id").alias("a"), F.col("event_idr").alias("b"), "inter", F.expr("area + arear - inter").alias("joint"))


def mask_ious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one camera and moment whose masks share pixels: shared and joint pixels."""
    return _pairs(spark, sf_dir)


def mask_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per detection whether it stays: the first of a moment do, unless half of the joint pixels are shared with one that stayed."""
    gone = masks.keep_first(_pairs(spark, sf_dir).where("2 * inter >= joint").select(F.col("a").alias("early"), F.col("b").alias("late")))
    return detections(spark, sf_dir).select("event_id").join(gone.withColumnRenamed("node", "event_id").withColumn("gone", F.lit(True)), "event_id", "left").select("event_id", F.col("gone").isNull().alias("stays"))


_PIXELS = f"""{EV}, s AS (SELECT *, {", ".join(f"CAST({e.replace(' DIV ', ' // ')} AS BIGINT) AS {n}" for n, e in _SHAPE.items())} FROM ev),
px AS (SELECT event_id, cam, frame, x0 + i AS x, y0 + j AS y FROM s, LATERAL (SELECT unnest(range(w)) AS i), LATERAL (SELECT unnest(range(h)) AS j) WHERE ((2 * i + 1 - w) * h) ** 2 + ((2 * j + 1 - h) * w) ** 2 <= (w * h) ** 2),
area AS (SELECT event_id, count(*) AS n FROM px GROUP BY event_id),
ious AS (SELECT p.event_id AS a, q.event_id AS b, count(*) AS inter, any_value(m.n) + any_value(o.n) - count(*) AS joint FROM px p JOIN px q ON p.cam = q.cam AND p.frame = q.frame AND p.x = q.x AND p.y = q.y AND p.event_id < q.event_id
  JOIN area m ON m.event_id = p.event_id JOIN area o ON o.event_id = q.event_id GROUP BY p.event_id, q.event_id)"""
IOUS_SQL = f"WITH {_PIXELS} SELECT a, b, inter, joint FROM ious"
DEDUP_SQL = f"""WITH RECURSIVE {_PIXELS},
turn AS (SELECT event_id, cam, frame, row_number() OVER (PARTITION BY cam, frame ORDER BY event_id) AS k, coalesce((SELECT list(a) FROM ious WHERE b = s.event_id AND 2 * inter >= joint), []) AS rivals FROM s),
taken AS (SELECT DISTINCT cam, frame, 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS event_id, false AS stays FROM turn
  UNION ALL SELECT n.cam, n.frame, n.k, CASE WHEN len(list_intersect(n.rivals, t.kept)) = 0 THEN list_append(t.kept, n.event_id) ELSE t.kept END, n.event_id, len(list_intersect(n.rivals, t.kept)) = 0
  FROM taken t JOIN turn n ON n.cam = t.cam AND n.frame = t.frame AND n.k = t.k + 1)
SELECT event_id, stays FROM taken WHERE k > 0"""


def second_detector(df: DataFrame) -> DataFrame:
    """The same moments seen by another detector: boxes a few pixels off, some missed."""
    return df.where("event_id % 9 <> 4").selectExpr("cam", "frame", "event_id + 1000000000 AS det", "x0 + event_id % 5 - 2 AS x0", "y0 + event_id % 7 - 3 AS y0", "x1 + event_id % 3 AS x1", "y1 + event_id % 5 - 2 AS y1")


def truth_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users carried from one detector's boxes to the other's of the same moment, by the best one-to-one overlap above a half."""
    seen = cut(detections(spark, sf_dir), "transfer-seen")
    truth = seen.select("cam", "frame", F.col("event_id").alias("truth"), F.col("user_id").alias("label"), *masks.BOX)
    return masks.transfer_labels(second_detector(seen), truth, ["cam", "frame"], 0.5, CELL).select("cam", "frame", "det", "label", F.round("iou", 9).alias("iou"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cam, chunk, frame, local, box, mask): every chunk numbers its own people; a later chunk sees shared moments a pixel off. A user has one row a frame."""
    seen = detections(spark, sf_dir).where("cam is not null").withColumn("frame", F.expr(f"us div {HOUR // 2}"))
    one = seen.groupBy("cam", "frame", "user_id").agg(F.min_by(F.struct("us", *masks.BOX), "event_id").alias("s")).select("cam", "frame", "user_id", "s.*")
    own = F.expr(f"us div {CHUNK}")
    rows = one.withColumn("chunk", F.explode(F.when((F.col("us") % CHUNK < SHARED), F.array(own - 1, own)).otherwise(F.array(own))))
    late = F.when(own == F.col("chunk"), F.lit(1)).otherwise(F.lit(0))
    rows = rows.select("cam", "chunk", "frame", F.expr("user_id * 64 + chunk % 64").alias("local"), (F.col("x0") + late).alias("x0"), "y0", (F.col("x1") + late).alias("x1"), "y1")
    return with_ellipses(rows)


def chunk_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that stays and its piece, through all chunks."""
    return masks.link_chunks(chunk_rows(spark, sf_dir), ["cam"], 0.3, CELL)[1]


QUERIES = {"mask_ious": (mask_ious, IOUS_SQL), "mask_dedup": (mask_dedup, DEDUP_SQL), "truth_transfer": (truth_transfer, None), "chunk_seams": (chunk_seams, None)}
