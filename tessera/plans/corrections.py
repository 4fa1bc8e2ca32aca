"""Corrections as logs: review states of documents, people of a day after film edits. The event log stands in for both.

A document is a user, its pieces are the user's days, its detections the events. A track is what six hours hold of a user; an
event is also an edit of its track by its type, made against the number of events that the track had two hours later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import film_edits, review_log
from ..operators.scratch import cut
from ..sources import events
from .event_sequences import DAY, EV, HOUR

_CENTS = "CAST(round(value * 100) AS BIGINT)"


def review_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pieces (doc, piece, det, t) and operations (doc, seq, action, pieces, value, other, at, expected)."""
    log = events(spark, sf_dir).withColumn("cents", F.expr(_CENTS)).withColumn("day", F.expr(f"us div {DAY} - 19723"))
    pieces = log.select(F.col("user_id").alias("doc"), F.col("day").cast("int").alias("piece"), F.col("event_id").alias("det"), (F.col("us") / 1_000_000).alias("t"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    told = log.withColumn("before", F.coalesce(F.lag("day").over(w), F.col("day"))).withColumn("k", F.row_number().over(w) - 1)
    action = F.expr("CASE event_type WHEN 'click' THEN 'label' WHEN 'view' THEN 'quality' WHEN 'signup' THEN 'relation' WHEN 'purchase' THEN CASE WHEN cents % 3 = 0 THEN 'merge' ELSE 'split' END ELSE 'undo' END")
    value = F.expr("CASE event_type WHEN 'click' THEN element_at(array('NEW', 'P1', ''), CAST(cents % 3 + 1 AS INT)) WHEN 'view' THEN element_at(array('good', 'bad', 'odd'), CAST(cents % 3 + 1 AS INT)) WHEN 'signup' THEN element_at(array('same', 'different', 'unsure'), CAST(cents % 3 + 1 AS INT)) WHEN 'purchase' THEN 'P2' END")
    ids = F.when(F.col("event_type") == "signup", F.array("before", "day")).otherwise(F.array("day")).cast("array<int>")
    operations = told.select(
        F.col("user_id").alias("doc"), F.col("k").alias("seq"), action.alias("action"), ids.alias("pieces"), value.alias("value"), F.lit("P1").alias("other"), (F.col("us") / 1_000_000).alias("at"), F.when(F.col("cents") % 7 == 0, F.col("k").cast("bigint")).alias("expected")
    )
    return pieces, operations


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation's outcome, every piece's and relation's final state."""
    return review_log.fold_reviews(*review_rows(spark, sf_dir)).withColumn("dets", F.array_join(F.col("dets").cast("array<string>"), ",")).withColumnRenamed("first", "begins").withColumnRenamed("last", "ends")


def film_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, links and edits of every day."""
    log = events(spark, sf_dir).withColumn("cents", F.expr(_CENTS)).withColumn("day", F.expr(f"us div {DAY}")).withColumn("s", F.expr(f"CAST(us % {DAY} div 1000000 AS DOUBLE)"))
    log = cut(log.withColumn("track", F.expr(f"concat(user_id, '-', us div {6 * HOUR})")), "film-log")
    tracks = log.groupBy("day", "track", "user_id").agg(F.min("s").alias("first"), (F.max("s") + 600).alias("last"), F.count("*").cast("string").alias("fp"))
    nxt = F.lead("track").over(Window.partitionBy("day", "user_id").orderBy("first"))
    links = tracks.select("day", F.col("track").alias("a"), nxt.alias("b")).where("b is not null")
    own = F.count("*").over(Window.partitionBy("track").orderBy("s").rangeBetween(Window.unboundedPreceding, 7200)).cast("string")
    before = F.lag("track").over(Window.partitionBy("day", F.expr("user_id div 50")).orderBy("event_id"))
    action = F.expr("CASE WHEN event_type = 'purchase' THEN 'split' WHEN event_type = 'signup' THEN 'same' WHEN event_type = 'error' AND cents % 2 = 0 THEN 'false' WHEN event_type = 'view' AND cents % 5 = 0 THEN 'kind' WHEN event_type = 'click' AND cents % 7 = 0 THEN 'undo' END")
    kind = F.expr("element_at(array('staff', 'customer', 'passer'), CAST(cents % 3 + 1 AS INT))")
    edits = log.select(
        "day", F.col("event_id").alias("seq"), action.alias("action"), "track", F.concat("track", F.lit("@")).alias("part"), F.concat(before, F.lit("@")).alias("target"), (F.col("s") + 300).alias("at"), kind.alias("kind"), own.alias("print")
    ).where("action is not null and (action <> 'same' or target is not null)")
    return tracks.select("day", "track", "first", "last", "fp"), links, edits


def film_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of a day's tracks and whose it is after the edits that count."""
    return film_edits.people(*film_rows(spark, sf_dir)).withColumnRenamed("first", "begins").withColumnRenamed("last", "ends").withColumnRenamed("false", "no_person")


FILM_SQL = f"""WITH RECURSIVE {EV}, k AS (SELECT *, {_CENTS} AS cents, us // {DAY} AS day, (us % {DAY} // 1000000)::DOUBLE AS s, user_id || '-' || us // {6 * HOUR} AS track FROM ev),
tracks AS (SELECT day, track, user_id, min(s) AS first, max(s) + 600 AS last, count(*) AS fp FROM k GROUP BY day, track, user_id),
e0 AS (SELECT day, event_id AS seq, track, track || '@' AS part, lag(track) OVER (PARTITION BY day, user_id // 50 ORDER BY event_id) || '@' AS target, s + 300 AS moment, ['staff', 'customer', 'passer'][cents % 3 + 1] AS kind,
  count(*) OVER (PARTITION BY track ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 7200 FOLLOWING) AS print,
  CASE WHEN event_type = 'purchase' THEN 'split' WHEN event_type = 'signup' THEN 'same' WHEN event_type = 'error' AND cents % 2 = 0 THEN 'false' WHEN event_type = 'view' AND cents % 5 = 0 THEN 'kind' WHEN event_type = 'click' AND cents % 7 = 0 THEN 'undo' END AS action FROM k),
edits AS (SELECT * FROM e0 WHERE action IS NOT NULL AND (action <> 'same' OR target IS NOT NULL)),
stale AS (SELECT DISTINCT track FROM edits JOIN tracks USING (track) WHERE print <> fp),
told AS (SELECT *, lead(action) OVER (PARTITION BY day ORDER BY seq) AS nxt FROM edits),
live AS (SELECT * FROM told WHERE action <> 'undo' AND nxt IS DISTINCT FROM 'undo' AND track NOT IN (FROM stale)),
cuts AS (SELECT *, coalesce(lag(moment) OVER (PARTITION BY track ORDER BY moment), first) AS since FROM (SELECT DISTINCT t.day, t.track, moment, first, last FROM live JOIN tracks t USING (track) WHERE action = 'split' AND moment < last)),
b AS (SELECT day, track, first AS since, track || '@' AS part, track IN (SELECT track FROM cuts c WHERE moment - since < 1 AND since = tracks.first) AS away FROM tracks
  UNION ALL SELECT day, track, moment, printf('%s@%.2f', track, moment), true FROM cuts WHERE moment - since >= 1),
parts AS (SELECT b.day, b.track, b.part, b.since AS first, coalesce(lead(b.since) OVER (PARTITION BY b.track ORDER BY b.since), t.last) AS last, b.away, row_number() OVER (PARTITION BY b.track ORDER BY b.since) AS k, count(*) OVER (PARTITION BY b.track) AS n FROM b JOIN tracks t USING (track)),
joined AS (SELECT day, p AS part, max(seq) AS seq FROM (SELECT day, seq, unnest([part, target]) AS p FROM live WHERE action = 'same') GROUP BY day, p),
wrong AS (SELECT m.part FROM live m LEFT JOIN joined j ON j.day = m.day AND j.part = m.part WHERE m.action = 'false' AND (j.seq IS NULL OR m.seq > j.seq) GROUP BY m.part HAVING count(*) % 2 = 1),
real AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY first) AS i, row_number() OVER (PARTITION BY track ORDER BY first DESC) AS j FROM parts WHERE part NOT IN (FROM wrong)),
chain AS (SELECT x.part AS a, y.part AS b FROM real x JOIN real y ON x.track = y.track AND y.i = x.i + 1 AND NOT y.away
  UNION SELECT x.part, y.part FROM (SELECT track AS a, lead(track) OVER (PARTITION BY day, user_id ORDER BY first) AS b FROM tracks) l JOIN real x ON x.track = l.a AND x.j = 1 JOIN real y ON y.track = l.b AND y.i = 1 AND NOT y.away
  UNION SELECT part, target FROM live WHERE action = 'same'),
ways AS (SELECT a, b FROM chain UNION SELECT b, a FROM chain),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
who AS (SELECT p.*, CASE WHEN p.part NOT IN (FROM wrong) THEN p.day || '|' || least(p.part, coalesce((SELECT min(b) FROM reach WHERE reach.a = p.part), p.part)) END AS person FROM parts p),
kinds AS (SELECT person, arg_max(kind, seq) AS kind FROM live JOIN who USING (part) WHERE action = 'kind' AND person IS NOT NULL GROUP BY person)
SELECT w.day, w.track, w.part, w.first AS begins, w.last AS ends, w.person, CASE WHEN w.person IS NOT NULL THEN coalesce(k.kind, 'customer') END AS kind, w.part IN (FROM wrong) AS no_person, w.track IN (FROM stale) AS stale
FROM who w LEFT JOIN kinds k ON k.person = w.person"""

QUERIES = {"review_states": (review_states, None), "film_people": (film_people, FILM_SQL)}
