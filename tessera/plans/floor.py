"""Geometry and predicates over detections: order lines stand for the boxes of a frame (their order), events for points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators.greedy import per_groups
from ..sources import events, read_table
from .event_sequences import EV, HOUR

CAM = g.Camera(0.5, -1.0, 3.2, 0.7, 0.55, 1150.0, 1280.0, 720.0, -0.08)
FLOOR = [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (6.0, 4.0), (6.0, 8.0), (0.0, 8.0)]
DOOR = ((2.0, 0.0), (4.0, 0.5))
INSIDE = (3.0, 5.0)
TALL, PRIOR = 1.7, 1.68
_BOX = {
    "frame": "l_orderkey", "det": "CAST(l_linenumber AS BIGINT)", "cam": "CAST(l_linenumber % 2 AS BIGINT)", "x0": "(l_partkey * 37) % 2300", "y0": "(l_suppkey * 53) % 900",
    "x1": "(l_partkey * 37) % 2300 + 60 + (l_partkey % 9) * 45", "y1": "(l_suppkey * 53) % 900 + 90 + (l_suppkey % 11) * 60", "conf": "CAST(round(l_discount * 100) AS BIGINT)", "mark": "l_returnflag",
}
BOX = "b AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BOX.items()) + " FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer boxes (frame, det, cam, x0, y0, x1, y1, conf, mark)."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _BOX.items()])


def _mm(e: str) -> str:
    """Metres as whole millimetres."""
    return f"CAST(floor(({e}) * 1000.0 + 0.5) AS BIGINT)"


_FOOT = {"fu": "CAST((x0 + x1) / 2.0 AS DOUBLE)", "fv": "CAST(y1 AS DOUBLE)", "hv": "CAST(y0 AS DOUBLE)"}
_NORMAL = dict(zip(("a", "bf"), g.undistorted(CAM, "fu", "fv"), strict=True)) | {"bh": g.undistorted(CAM, "fu", "hv")[1]}
_RAYS = {f"f{k}": e for k, e in zip("xyz", g.ray(CAM, "a", "bf"), strict=True)} | {f"h{k}": e for k, e in zip("xyz", g.ray(CAM, "a", "bh"), strict=True)}
_PLACES = {"x": g.on_plane(CAM, ["fx", "fy", "fz"])[0], "y": g.on_plane(CAM, ["fx", "fy", "fz"])[1]}
_STEPS = (_FOOT, _NORMAL, _RAYS, _PLACES)


def _chain(df: DataFrame, *steps: dict[str, str]) -> DataFrame:
    """``df`` with the columns of each step, which may use those before. The generator keeps the optimizer from writing a step's
    expressions out wherever they are used, which would double their size with every step."""
    for step in steps:
        df = df.selectExpr("*", "inline_outer(array(named_struct(" + ", ".join(f"'{n}', {e}" for n, e in step.items()) + ")))")
    return df


def _sql(columns: str, *steps: dict[str, str], where: str = "true") -> str:
    ctes = [BOX, "q0 AS (SELECT * FROM b)"]
    for k, step in enumerate(steps):
        ctes.append(f"q{k + 1} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM q{k})")
    return f"WITH {', '.join(ctes)} SELECT {columns} FROM q{len(steps)} WHERE {where}"


def floor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box's foot on the floor: undistorted, rotated, met with the plane; null behind the camera."""
    return _chain(_boxes(spark, sf_dir), *_STEPS).selectExpr("frame", "det", f"{_mm('x')} AS x_mm", f"{_mm('y')} AS y_mm")


FLOOR_SQL = _sql(f"frame, det, {_mm('x')} AS x_mm, {_mm('y')} AS y_mm", *_STEPS)

# The upright through the foot ray's floor point meets the head ray best where its plan distance is least.
_HEIGHT = {"t": "((x - 0.5) * hx + (y + 1.0) * hy) / nullif(hx * hx + hy * hy, 0.0)"}
_TALL = {"tall": f"CASE WHEN t > 0.0 THEN {CAM.z!r} + t * hz END"}


def person_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height from foot and head rays: the head ray's height where it passes nearest the upright over the foot; null if there is none."""
    return _chain(_boxes(spark, sf_dir), *_STEPS, _HEIGHT, _TALL).selectExpr("frame", "det", f"{_mm('tall')} AS height_mm")


HEIGHTS_SQL = _sql(f"frame, det, {_mm('tall')} AS height_mm", *_STEPS, _HEIGHT, _TALL)
_VISIBLE = {"visible": f"(x0 > 2 AND x1 < 2558 AND y1 < 1436 AND x IS NOT NULL AND coalesce({g.in_polygon(FLOOR, 'x', 'y')}, false))"}
_HEAD = {"px": g.on_plane(CAM, ["hx", "hy", "hz"], repr(PRIOR))[0], "py": g.on_plane(CAM, ["hx", "hy", "hz"], repr(PRIOR))[1]}
_AFFINE = {"mx": "CASE WHEN visible THEN x ELSE px END", "my": "CASE WHEN visible THEN y ELSE py END"}
_MAPPED = {"cx": "CASE WHEN cam = 1 THEN 0.98 * mx - 0.05 * my + 0.12 ELSE mx END", "cy": "CASE WHEN cam = 1 THEN 0.04 * mx + 1.01 * my - 0.2 ELSE my END"}
_PLACE = (*_STEPS, _VISIBLE, _HEAD, _AFFINE, _MAPPED)


def foot_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a foot is seen: inside the frame, not cut, on the floor's outline."""
    return _chain(_boxes(spark, sf_dir), *_STEPS, _VISIBLE).select("frame", "det", "visible")


VISIBLE_SQL = _sql("frame, det, visible", *_STEPS, _VISIBLE)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foot if seen, else the head at the prior height; the second camera mapped affinely into the first one's frame."""
    return _chain(_boxes(spark, sf_dir), *_PLACE).selectExpr("frame", "det", "visible", f"{_mm('cx')} AS x_mm", f"{_mm('cy')} AS y_mm")


PLACES_SQL = _sql(f"frame, det, visible, {_mm('cx')} AS x_mm, {_mm('cy')} AS y_mm", *_PLACE)
_EXPECT = {"top": g.projected(CAM, "x", "y", repr(TALL))[1], "low": g.projected(CAM, "x", "y", "0.0")[1]}


def expected_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels a person of 1.7 m would take at a box's place, by projecting back."""
    return _chain(_boxes(spark, sf_dir), *_STEPS, _EXPECT).where("x is not null").selectExpr("frame", "det", f"{_mm('low - top')} AS expected_mpx")


EXPECTED_SQL = _sql(f"frame, det, {_mm('low - top')} AS expected_mpx", *_STEPS, _EXPECT, where="x IS NOT NULL")
_RATIO = {"ratio": "(y1 - y0) / nullif(low - top, 0.0)"}
_PLAUSIBLE = f"ratio > 0.25 AND ratio < 1.45 AND (tall IS NULL OR (tall > 1.05 AND tall < 2.15)) AND {g.in_polygon(FLOOR, 'x', 'y')}"


def plausible_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a believable size, for their place and as measured, inside the shop."""
    return _chain(_boxes(spark, sf_dir), *_STEPS, _HEIGHT, _TALL, _EXPECT, _RATIO).where(_PLAUSIBLE).selectExpr("frame", "det", f"{_mm('ratio')} AS ratio_milli")


PLAUSIBLE_SQL = _sql(f"frame, det, {_mm('ratio')} AS ratio_milli", *_STEPS, _HEIGHT, _TALL, _EXPECT, _RATIO, where=_PLAUSIBLE)
_POINT = {"px": "value / 50.0", "py": "CAST(user_id % 97 AS DOUBLE) / 10.0"}
_DOOR = {"side": g.line_distance(*DOOR, INSIDE, "px", "py"), "gap": g.segment_distance(*DOOR, "px", "py")}
_ZONE = "CASE WHEN side > 0.3 THEN 'in' WHEN side < -0.3 THEN 'out' ELSE 'door' END"


def door_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distance to the door's line (inside positive), distance to its segment, and the zone with a margin."""
    return _chain(events(spark, sf_dir), _POINT, _DOOR).selectExpr("event_id", f"{_mm('side')} AS side_mm", f"{_mm('gap')} AS gap_mm", f"{_ZONE} AS zone")


def _point_sql(columns: str, *steps: dict[str, str], tail: str = "") -> str:
    ctes = [EV, "q0 AS (SELECT * FROM ev)"] + [f"q{k + 1} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM q{k})" for k, step in enumerate(steps)]
    return f"WITH {', '.join(ctes)} SELECT {columns} FROM q{len(steps)} {tail}"


DOOR_SQL = _point_sql(f"event_id, {_mm('side')} AS side_mm, {_mm('gap')} AS gap_mm, {_ZONE} AS zone", _POINT, _DOOR)
_SHARE = {"inside": g.in_polygon(FLOOR, "px", "py"), "edge": g.edge_distance(FLOOR, "px", "py")}
_SHARES = f"count(*) AS n, CAST(sum(CASE WHEN inside THEN 1 ELSE 0 END) AS BIGINT) AS n_inside, max({_mm('edge')}) AS deepest_mm, min({_mm('edge')}) AS farthest_mm"


def floor_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: points on the floor's polygon and the largest and smallest signed distance to its edge."""
    inside = _chain(events(spark, sf_dir), _POINT, _SHARE)
    edge = F.expr(_mm("edge"))
    return inside.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"), F.max(edge).alias("deepest_mm"), F.min(edge).alias("farthest_mm"))


SHARES_SQL = _point_sql(f"user_id, {_SHARES}", _POINT, _SHARE, tail="GROUP BY user_id")


def _with_overlaps(boxes: DataFrame) -> DataFrame:
    """Boxes with ``shared``, the largest part of a box that another box of its frame covers, and ``iou``, in thousandths."""
    other = boxes.select("frame", F.col("det").alias("odet"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    mine = boxes.select("frame", "det", *[F.col(c).alias(f"m{c}") for c in ("x0", "y0", "x1", "y1")])
    met = mine.join(other, "frame").where("det <> odet").withColumn("common", F.expr(g.overlap_area("m", "o")))
    best = met.groupBy("frame", "det").agg(
        F.max(F.expr("common * 1000 div ((mx1 - mx0) * (my1 - my0))")).alias("shared"), F.max(F.expr("common * 1000 div ((mx1 - mx0) * (my1 - my0) + (ox1 - ox0) * (oy1 - oy0) - common)")).alias("iou"), F.count_if(F.expr("common > 0")).alias("touching")
    )
    return boxes.join(best, ["frame", "det"], "left").na.fill(0, ["shared", "iou", "touching"])


_MET = f"""met AS (SELECT m.frame, m.det, {g.overlap_area('m.', 'o.')} AS common, (m.x1 - m.x0) * (m.y1 - m.y0) AS ma, (o.x1 - o.x0) * (o.y1 - o.y0) AS oa FROM b m JOIN b o ON m.frame = o.frame AND m.det <> o.det),
best AS (SELECT frame, det, max(common * 1000 // ma) AS shared, max(common * 1000 // (ma + oa - common)) AS iou, count(*) FILTER (common > 0) AS touching FROM met GROUP BY frame, det),
o AS (SELECT b.*, coalesce(shared, 0) AS shared, coalesce(iou, 0) AS iou, coalesce(touching, 0) AS touching FROM b LEFT JOIN best USING (frame, det))"""
# The outline of a detection: its box with a corner cut off by the confidence; the area is the shoelace sum.
_AREA = "abs((x0 * y0 - x1 * y0) + (x1 * (y1 - conf * 5) - x1 * y0) + (x1 * y1 - (x1 - conf * 4) * (y1 - conf * 5)) + ((x1 - conf * 4) * y1 - x0 * y1) + (x0 * y0 - x0 * y1))"


def clean_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose outline fills over 0.30 of the box and that no other box of the frame covers by 0.20 or more."""
    clean = F.expr(f"{_AREA} * 10 > 2 * 3 * (x1 - x0) * (y1 - y0) AND shared < 200")
    return _with_overlaps(_boxes(spark, sf_dir)).select("frame", "det", F.expr(f"CAST({_AREA} AS BIGINT) AS area2"), "shared", clean.alias("clean"))


CLEAN_SQL = f"WITH {BOX}, {_MET} SELECT frame, det, CAST({_AREA} AS BIGINT) AS area2, shared, {_AREA} * 10 > 2 * 3 * (x1 - x0) * (y1 - y0) AND shared < 200 AS clean FROM o"


def clean_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks worth keeping: tall, sure, untouched by others (IoU at most 0.05) and moved since the camera's last kept one.

    The last kept one, not the one before: a slow walk is kept every 40 pixels. A frame's few looks are walked in order.
    """

    def keep(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        at, last, stay = -1, None, []
        for g, x in zip(group.tolist(), f["x0"].tolist(), strict=True):
            stay.append(g != at or abs(x - last) >= 40)
            at, last = g, x if stay[-1] else last
        return f.loc[stay, ["frame", "det", "iou"]]

    sure = _with_overlaps(_boxes(spark, sf_dir)).where("y1 - y0 >= 200 and conf >= 3 and iou <= 50").select("frame", "cam", "det", *("x0", "y0", "x1", "y1"), "iou")
    kinds = {c: sure.schema[c].dataType.simpleString() for c in ("frame", "det", "iou")}
    return per_groups(sure, ["frame", "cam"], ["det", "x0", "y0", "x1", "y1", "iou"], keep, ", ".join(f"{c} {k}" for c, k in kinds.items()))


LOOKS_SQL = f"""WITH RECURSIVE {BOX}, {_MET}, s AS (SELECT *, row_number() OVER (PARTITION BY frame, cam ORDER BY det, x0, y0, x1, y1, iou) AS k FROM o WHERE y1 - y0 >= 200 AND conf >= 3 AND iou <= 50),
t AS (SELECT frame, cam, k, det, iou, x0 AS last, true AS stays FROM s WHERE k = 1
  UNION ALL SELECT s.frame, s.cam, s.k, s.det, s.iou, CASE WHEN abs(s.x0 - t.last) >= 40 THEN s.x0 ELSE t.last END, abs(s.x0 - t.last) >= 40 FROM t JOIN s ON s.frame = t.frame AND s.cam = t.cam AND s.k = t.k + 1)
SELECT frame, det, iou FROM t WHERE stays"""


def frame_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame: people, 3 for every overlapping pair, 3 if the sizes differ by a ratio under 0.7."""
    by_frame = _with_overlaps(_boxes(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("people"), F.sum("touching").alias("touches"), F.min(F.expr("y1 - y0")).alias("low"), F.max(F.expr("y1 - y0")).alias("high"))
    return by_frame.selectExpr("frame", "people", "people + 3 * (touches div 2) + CASE WHEN low * 10 < high * 7 THEN 3 ELSE 0 END AS hardness")


HARD_SQL = f"""WITH {BOX}, {_MET}, f AS (SELECT frame, count(*) AS people, CAST(sum(touching) AS BIGINT) AS touches, min(y1 - y0) AS low, max(y1 - y0) AS high FROM o GROUP BY frame)
SELECT frame, people, people + 3 * (touches // 2) + CASE WHEN low * 10 < high * 7 THEN 3 ELSE 0 END AS hardness FROM f"""


def edge_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: boxes at the frame's edge, and whether the order counts as a visitor (a box on the floor or three boxes)."""
    seen = _chain(_boxes(spark, sf_dir), *_STEPS, _VISIBLE).withColumn("edge", F.expr("x0 <= 4 or y0 <= 4 or x1 >= 2556 or y1 >= 1436"))
    return seen.groupBy("frame").agg(F.count_if("edge").alias("at_edge"), (F.max(F.col("visible").cast("int")) + (F.count("*") >= 3).cast("int") > 0).alias("visitor"))


EDGE_SQL = _sql("frame, count(*) FILTER (x0 <= 4 OR y0 <= 4 OR x1 >= 2556 OR y1 >= 1436) AS at_edge, (bool_or(visible) OR count(*) >= 3) AS visitor", *_STEPS, _VISIBLE) + " GROUP BY frame"


def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: whether its boxes can carry an identity: median height of at least 300 pixels and a fifth of them clean."""
    tall = _with_overlaps(_boxes(spark, sf_dir)).groupBy("mark", "cam").agg(F.median(F.expr("y1 - y0")).alias("height"), F.count_if(F.expr("shared < 200")).alias("clean"), F.count("*").alias("n"))
    return tall.select("mark", "cam", "height", "clean", "n", F.expr("height >= 300 and clean * 5 >= n").alias("strong"))


STRENGTH_SQL = f"WITH {BOX}, {_MET}, t AS (SELECT mark, cam, median(y1 - y0) AS height, count(*) FILTER (shared < 200) AS clean, count(*) AS n FROM o GROUP BY mark, cam) SELECT *, height >= 300 AND clean * 5 >= n AS strong FROM t"


def roi_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes outside the region of interest, or too small for the frame's height, per camera and mark."""
    flagged = _boxes(spark, sf_dir).selectExpr("cam", "mark", "(x0 + x1) / 2 < 300 OR (x0 + x1) / 2 > 2200 OR y1 < 200 AS outside", "(y1 - y0) * 100 < 12 * 1440 OR conf < 2 AS small")
    return flagged.groupBy("cam", "mark").agg(F.count("*").alias("n"), F.count_if("outside").alias("outside"), F.count_if("small").alias("small"), F.count_if(F.expr("not outside and not small")).alias("kept"))


ROI_SQL = f"""WITH {BOX}, f AS (SELECT cam, mark, (x0 + x1) / 2 < 300 OR (x0 + x1) / 2 > 2200 OR y1 < 200 AS outside, (y1 - y0) * 100 < 12 * 1440 OR conf < 2 AS small FROM b)
SELECT cam, mark, count(*) AS n, count(*) FILTER (outside) AS outside, count(*) FILTER (small) AS small, count(*) FILTER (NOT outside AND NOT small) AS kept FROM f GROUP BY cam, mark"""


def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers a learned box filter reads: place and size relative to the frame, aspect, filled part; means per mark."""
    numbers = _boxes(spark, sf_dir).selectExpr("mark", "(x0 + x1) * 1000 div 5120 AS fx", "y1 * 1000 div 1440 AS fy", "(x1 - x0) * 1000 div (y1 - y0) AS aspect", f"{_AREA} * 500 div ((x1 - x0) * (y1 - y0)) AS filled")
    return numbers.groupBy("mark").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "aspect", "filled")], F.count("*").alias("n"))


FEATURES_SQL = f"""WITH {BOX}, f AS (SELECT mark, (x0 + x1) * 1000 // 5120 AS fx, y1 * 1000 // 1440 AS fy, (x1 - x0) * 1000 // (y1 - y0) AS aspect, {_AREA} * 500 // ((x1 - x0) * (y1 - y0)) AS filled FROM b)
SELECT mark, CAST(sum(fx) AS BIGINT) AS fx, CAST(sum(fy) AS BIGINT) AS fy, CAST(sum(aspect) AS BIGINT) AS aspect, CAST(sum(filled) AS BIGINT) AS filled, count(*) AS n FROM f GROUP BY mark"""


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by their reviews (A accepts, R rejects, both conflict): frames stay whose detections are all decided, with their counts."""
    votes = _boxes(spark, sf_dir).groupBy("frame", F.expr("det % 3").alias("piece")).agg(F.count_if(F.expr("mark = 'A'")).alias("yes"), F.count_if(F.expr("mark = 'R'")).alias("no"))
    status = votes.withColumn("status", F.expr("CASE WHEN yes > 0 AND no > 0 THEN 'unresolved' WHEN yes > 0 THEN 'accepted' WHEN no > 0 THEN 'rejected' ELSE 'unresolved' END"))
    return status.groupBy("frame").agg(F.count_if(F.expr("status = 'accepted'")).alias("accepted"), F.count_if(F.expr("status = 'rejected'")).alias("rejected"), F.count_if(F.expr("status = 'unresolved'")).alias("open")).where("open = 0").drop("open")


REVIEW_SQL = f"""WITH {BOX}, v AS (SELECT frame, det % 3 AS piece, count(*) FILTER (mark = 'A') AS yes, count(*) FILTER (mark = 'R') AS no FROM b GROUP BY frame, det % 3),
s AS (SELECT frame, CASE WHEN yes > 0 AND no > 0 THEN 'unresolved' WHEN yes > 0 THEN 'accepted' WHEN no > 0 THEN 'rejected' ELSE 'unresolved' END AS status FROM v)
SELECT frame, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM s GROUP BY frame HAVING count(*) FILTER (status = 'unresolved') = 0"""


def three_way_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete, check or keep by two cuts of a score; a human answer wins; texts under 200 characters are left out."""
    docs = read_table(spark, sf_dir, "documents").where("n_chars >= 200").select("doc_id", F.expr("n_chars % 1000").alias("score"))
    human = read_table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.expr("CASE WHEN quality = 1 THEN 'keep' ELSE 'delete' END AS human"))
    machine = "CASE WHEN score >= 850 THEN 'delete' WHEN score >= 10 THEN 'check' ELSE 'keep' END"
    return docs.join(human, "doc_id", "left").selectExpr("doc_id", f"coalesce(human, {machine}) AS decision", "human IS NOT NULL AS by_human")


THREE_SQL = """SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'keep' WHEN quality = 0 THEN 'delete' END, CASE WHEN n_chars % 1000 >= 850 THEN 'delete' WHEN n_chars % 1000 >= 10 THEN 'check' ELSE 'keep' END) AS decision,
quality IS NOT NULL AS by_human FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality IS NOT NULL) l ON d.doc_id = l.doc_id WHERE n_chars >= 200"""


def motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to process: activity (a click) was seen in the last 6 hours of the user, this one included; with the hold since then."""
    seen = F.max(F.when(F.col("event_type") == "click", F.col("us"))).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    return events(spark, sf_dir).withColumn("hold_us", F.col("us") - seen).where(F.col("hold_us") <= 6 * HOUR).select("event_id", "hold_us")


MOTION_SQL = f"""WITH {EV}, s AS (SELECT *, us - max(CASE WHEN event_type = 'click' THEN us END) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS hold_us FROM ev)
SELECT event_id, hold_us FROM s WHERE hold_us <= {6 * HOUR}"""

QUERIES = {
    "floor_points": (floor_points, FLOOR_SQL), "person_heights": (person_heights, HEIGHTS_SQL), "foot_visibility": (foot_visibility, VISIBLE_SQL), "places": (places, PLACES_SQL), "expected_heights": (expected_heights, EXPECTED_SQL),
    "plausible_people": (plausible_people, PLAUSIBLE_SQL), "door_zones": (door_zones, DOOR_SQL), "floor_shares": (floor_shares, SHARES_SQL), "clean_boxes": (clean_boxes, CLEAN_SQL), "clean_looks": (clean_looks, LOOKS_SQL),
    "frame_hardness": (frame_hardness, HARD_SQL), "edge_visitors": (edge_visitors, EDGE_SQL), "evidence_strength": (evidence_strength, STRENGTH_SQL), "roi_gates": (roi_gates, ROI_SQL), "box_features": (box_features, FEATURES_SQL),
    "review_status": (review_status, REVIEW_SQL), "three_way_decisions": (three_way_decisions, THREE_SQL), "motion_gate": (motion_gate, MOTION_SQL),
}
