"""State machines, runs and windows over the event log, conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, sequences
from ..sources import events, read_table
from ..sources.readers import micros

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"
SIDE = "CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type IN ('purchase', 'signup') THEN -1 END"
ORDER = ["us", "event_id"]


def visits_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: first and last event, crossings of a two-sided state that errors don't change."""
    sided = events(spark, sf_dir).withColumn("side", F.expr(SIDE))
    states = sequences.hysteresis(sided, ["user_id"], ORDER, "side")
    return states.groupBy("user_id").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), (F.max("us") - F.min("us")).alias("duration_us"), F.count_if("crossing").alias("crossings"), F.count_if(F.col("state") == 1).alias("rows_inside")
    )


VISITS_SQL = f"""WITH {EV}, s AS (SELECT *, last_value({SIDE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS state FROM ev),
c AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) <> state AS crossing FROM s)
SELECT user_id, min(us) AS first_us, max(us) AS last_us, max(us) - min(us) AS duration_us, count(*) FILTER (crossing) AS crossings, count(*) FILTER (state = 1) AS rows_inside FROM c GROUP BY user_id"""


def crossings_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one speaker side in a conversation; other roles are ignored."""
    side = F.expr("CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END")
    return sequences.runs(read_table(spark, sf_dir, "conversations").withColumn("side", side), ["conv_id"], ["turn"], "side", F.col("turn"), F.col("turn"))


CROSSINGS_SQL = """WITH k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS side FROM conversations),
c AS (SELECT *, CASE WHEN lag(side) OVER w = side THEN 0 ELSE 1 END AS c FROM k WHERE side IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, side, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, side"""


def debounce_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State flips when at least 70 % of at least three votes of the last six hours say so; changes per user."""
    voted = events(spark, sf_dir).withColumn("vote", F.expr(f"(({SIDE}) + 1) div 2").cast("int"))
    states = sequences.debounce(voted, ["user_id"], "us", "vote", 6 * HOUR, 0.7, 3)
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return states.withColumn("flip", F.coalesce(F.lag("state").over(w) != F.col("state"), F.lit(False))).groupBy("user_id").agg(F.count_if("flip").alias("flips"), F.count("state").alias("decided"), F.count("*").alias("n"))


DEBOUNCE_SQL = f"""WITH {EV}, v AS (SELECT *, (({SIDE}) + 1) // 2 AS vote FROM ev),
n AS (SELECT *, count(vote) OVER p AS n, sum(vote) OVER p AS ones FROM v WINDOW p AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN n >= 3 AND ones * 10 >= n * 7 THEN 1 WHEN n >= 3 AND ones * 10 <= n * 3 THEN 0 END AS now FROM n),
s AS (SELECT *, last_value(now IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS state FROM d),
f AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) <> state AS flip FROM s)
SELECT user_id, count(*) FILTER (flip) AS flips, count(state) AS decided, count(*) AS n FROM f GROUP BY user_id"""


def majority_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END")
    return sequences.majority(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("code")), ["conv_id"], ["turn"], "code", [0, 1, 2], 2)


MAJORITY_SQL = """WITH k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS code FROM conversations),
n AS (SELECT *, count(*) FILTER (code = 0) OVER w AS a, count(*) FILTER (code = 1) OVER w AS b, count(*) FILTER (code = 2) OVER w AS c FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT conv_id, turn, code, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS smooth FROM n"""


def median5_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.median5(events(spark, sf_dir), ["user_id"], ORDER, "value").select("event_id", "user_id", "value", "median5")


MEDIAN5_SQL = f"""WITH {EV} SELECT event_id, user_id, value, list_sort([lag(value, 2, 0.0) OVER w, lag(value, 1, 0.0) OVER w, value, lead(value, 1, 0.0) OVER w, lead(value, 2, 0.0) OVER w])[3] AS median5
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)"""


def look_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where the mean of 8 values from here on differs from that of the 8 before by 100 or more."""
    cents = events(spark, sf_dir).withColumn("cents", F.expr("cast(round(value * 100) as bigint)"))
    jumped = sequences.window_jump(cents, ["user_id"], ORDER, "cents", 8).where("abs(after - before) >= 10000")
    return jumped.select("event_id", "user_id", (F.col("before") * 8).cast("bigint").alias("before_sum"), (F.col("after") * 8).cast("bigint").alias("after_sum"))


JUMPS_SQL = f"""WITH {EV}, c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM ev),
j AS (SELECT event_id, user_id, count(*) OVER b AS nb, sum(cents) OVER b AS sb, count(*) OVER a AS na, sum(cents) OVER a AS sa FROM c
 WINDOW b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT event_id, user_id, CAST(sb AS BIGINT) AS before_sum, CAST(sa AS BIGINT) AS after_sum FROM j WHERE nb = 8 AND na = 8 AND abs(sa - sb) >= 80000"""


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the union of the thirty days after each order."""
    spans = read_table(spark, sf_dir, "orders").select("o_custkey", micros("o_orderdate").alias("start_us")).withColumn("end_us", F.col("start_us") + 30 * DAY)
    return intervals.interval_union(spans, ["o_custkey"], "start_us", "end_us")


UNION_SQL = f"""WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + {30 * DAY} AS b FROM orders),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT o_custkey, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM i GROUP BY o_custkey, island"""


def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps of at most 30 minutes."""
    return intervals.sessions(events(spark, sf_dir), ["user_id"], "us", 30 * MINUTE, F.count_distinct("event_type").alias("types"))


_SESSION_CTE = f"""{EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {30 * MINUTE} THEN 0 ELSE 1 END AS new FROM ev),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS island FROM g),
sess AS (SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS n, count(DISTINCT event_type) AS types FROM i GROUP BY user_id, island)"""
SESSIONS_SQL = f'WITH {_SESSION_CTE.replace("ORDER BY us RANGE UNBOUNDED PRECEDING", "ORDER BY us, event_id ROWS UNBOUNDED PRECEDING").replace("OVER (PARTITION BY user_id ORDER BY us)", "OVER (PARTITION BY user_id ORDER BY us, event_id)")} SELECT user_id, start, "end", n, types FROM sess'


def presence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where anybody is around: events of a type padded by 2 minutes, merged, cut into blocks of an hour at most."""
    padded = events(spark, sf_dir).select("event_type", (F.col("us") - 2 * MINUTE).alias("start_us"), (F.col("us") + 2 * MINUTE).alias("end_us"))
    merged = intervals.interval_union(padded, ["event_type"], "start_us", "end_us").drop("n")
    return intervals.cut_blocks(merged, "start_us", "end_us", HOUR)


PRESENCE_SQL = f"""WITH {EV}, s AS (SELECT event_type, us - {2 * MINUTE} AS a, us + {2 * MINUTE} AS b FROM ev),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n),
u AS (SELECT event_type, min(a) AS a, max(b) AS b FROM i GROUP BY event_type, island),
k AS (SELECT *, unnest(range(a, greatest(a, b - 1) + 1, {HOUR})) AS p FROM u)
SELECT event_type, p AS start_us, least(p + {HOUR}, b) AS end_us FROM k"""


def id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of event type in each user's time order; errors count as unassigned and are skipped."""
    typed = events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return sequences.switches(typed, ["user_id"], ORDER, "kind")


SWITCHES_SQL = f"""WITH {EV}, s AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) <> event_type AS s FROM ev WHERE event_type <> 'error')
SELECT user_id, count(*) AS rows, count(*) FILTER (s) AS switches FROM s GROUP BY user_id"""


def break_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks between consecutive events of different types: in view if at most 10 minutes apart, else lost."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    pairs = events(spark, sf_dir).select("user_id", "event_type", (F.col("us") - F.lag("us").over(w)).alias("gap"), (F.lag("event_type").over(w) != F.col("event_type")).alias("break"))
    return pairs.groupBy("event_type").agg(F.count_if(F.col("break") & (F.col("gap") <= 10 * MINUTE)).alias("visible"), F.count_if(F.col("break") & (F.col("gap") > 10 * MINUTE)).alias("lost"), F.count_if(F.col("break").isNull()).alias("orphans"))


BREAKS_SQL = f"""WITH {EV}, p AS (SELECT event_type, us - lag(us) OVER w AS gap, lag(event_type) OVER w <> event_type AS brk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_type, count(*) FILTER (brk AND gap <= {10 * MINUTE}) AS visible, count(*) FILTER (brk AND gap > {10 * MINUTE}) AS lost, count(*) FILTER (brk IS NULL) AS orphans FROM p GROUP BY event_type"""


def causal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event knows of its past: counts in the previous 300, 120 and 30 minutes, time since the last, opposite kind."""
    row = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    ev = events(spark, sf_dir).withColumn("past", F.count("*").over(row))
    before = lambda m: F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -m * MINUTE - 1))
    side = F.expr(SIDE)
    return ev.select(
        "event_id", *[(F.col("past") - before(m)).alias(f"n_{m}") for m in (300, 120, 30)], (F.col("us") - F.max("us").over(row)).alias("recency_us"),
        F.when(side == 1, F.count_if(side == -1).over(row)).when(side == -1, F.count_if(side == 1).over(row)).alias("opposite"),
    )


CAUSAL_SQL = f"""WITH {EV}, s AS (SELECT *, {SIDE} AS side FROM ev),
c AS (SELECT *, count(*) OVER r AS past, max(us) OVER r AS last_us, count(*) FILTER (side = 1) OVER r AS ins, count(*) FILTER (side = -1) OVER r AS outs FROM s WINDOW r AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, {", ".join(f"past - count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {m * MINUTE + 1} PRECEDING) AS n_{m}" for m in (300, 120, 30))},
us - last_us AS recency_us, CASE side WHEN 1 THEN outs WHEN -1 THEN ins END AS opposite FROM c"""


def pre_post_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around each purchase: sums of value in the day before and after, in cents, and which way they move."""
    near = Window.partitionBy("user_id").orderBy("us")
    ev = events(spark, sf_dir).withColumn("cents", F.expr("cast(round(value * 100) as bigint)"))
    out = ev.withColumn("pre", F.sum("cents").over(near.rangeBetween(-DAY, -1))).withColumn("post", F.sum("cents").over(near.rangeBetween(1, DAY)))
    return out.where("event_type = 'purchase'").select("event_id", "pre", "post", F.sign(F.coalesce("post", F.lit(0)) - F.coalesce("pre", F.lit(0))).cast("int").alias("move"))


PREPOST_SQL = f"""WITH {EV}, c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM ev),
p AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING) AS pre, sum(cents) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING) AS post FROM c)
SELECT event_id, CAST(pre AS BIGINT) AS pre, CAST(post AS BIGINT) AS post, CAST(sign(coalesce(post, 0) - coalesce(pre, 0)) AS INT) AS move FROM p WHERE event_type = 'purchase'"""


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts of each user; gaps of at most 12 hours are filled by straight lines, counted in sixtieths."""
    hourly = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / HOUR).alias("slot")).agg(F.count("*").cast("double").alias("n"))
    filled = sequences.gap_fill(hourly, ["user_id"], "slot", "n", 12)
    return filled.select("user_id", "slot", F.expr("cast(round(n * 27720) as bigint)").alias("n27720"), "filled")


GAPFILL_SQL = f"""WITH {EV}, h AS (SELECT user_id, us // {HOUR} AS slot, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY ALL),
p AS (SELECT *, lead(slot) OVER w - slot AS step, lead(n) OVER w AS v FROM h WINDOW w AS (PARTITION BY user_id ORDER BY slot)),
k AS (SELECT *, CASE WHEN step <= 12 THEN step ELSE 1 END AS m FROM p), e AS (SELECT *, unnest(range(0, coalesce(m, 1))) AS k FROM k)
SELECT user_id, slot + k AS slot, CAST(round((CASE WHEN k = 0 THEN n ELSE n + (v - n) * k / m END) * 27720) AS BIGINT) AS n27720, k > 0 AS filled FROM e"""


def rle_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive turn numbers of a conversation: where a run begins and how long its regular step lasts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    broken = turns.withColumn("c", F.when(F.col("turn") - F.lag("turn").over(w) == 1, 0).otherwise(1)).withColumn("run", F.sum("c").over(w))
    return broken.groupBy("conv_id", "run").agg(F.min("turn").alias("k"), F.count("*").alias("n"))


RLE_SQL = """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), c AS (SELECT *, CASE WHEN turn - lag(turn) OVER w = 1 THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c) SELECT conv_id, run, min(turn) AS k, count(*) AS n FROM r GROUP BY conv_id, run"""


def windows_ten_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every ten-minute window that starts 30 seconds after the first event, empty windows included."""
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = first.select(F.explode(F.expr(f"sequence(lo + {MINUTE // 2}, hi, {10 * MINUTE}L)")).alias("start_us"), "lo")
    slot = ev.crossJoin(F.broadcast(first)).where(F.col("us") >= F.col("lo") + MINUTE // 2).select((F.col("lo") + MINUTE // 2 + F.floor((F.col("us") - F.col("lo") - MINUTE // 2) / (10 * MINUTE)) * (10 * MINUTE)).alias("start_us"))
    counts = slot.groupBy("start_us").agg(F.count("*").alias("n"))
    return grid.join(counts, "start_us", "left").select("start_us", F.coalesce("n", F.lit(0)).alias("n"))


WINDOWS_SQL = f"""WITH {EV}, f AS (SELECT min(us) AS lo, max(us) AS hi FROM ev), g AS (SELECT unnest(range(lo + {MINUTE // 2}, hi + 1, {10 * MINUTE})) AS start_us FROM f),
c AS (SELECT lo + {MINUTE // 2} + ((us - lo - {MINUTE // 2}) // {10 * MINUTE}) * {10 * MINUTE} AS start_us, count(*) AS n FROM ev, f WHERE us >= lo + {MINUTE // 2} GROUP BY 1)
SELECT start_us, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (start_us)"""


def undither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings whose next crossing back follows within 20 hours are dropped together with it (neighbouring pairs)."""
    states = sequences.hysteresis(events(spark, sf_dir).withColumn("side", F.expr(SIDE)), ["user_id"], ORDER, "side").where("crossing")
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    quick = states.withColumn("q", F.coalesce(F.lead("us").over(w) - F.col("us") <= 20 * HOUR, F.lit(False))).withColumn("p", F.coalesce(F.lag("q").over(w), F.lit(False)))
    return quick.where("not q and not p").select("event_id", "user_id", "us", "state")


UNDITHER_SQL = f"""WITH {EV}, s AS (SELECT *, last_value({SIDE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS state FROM ev),
c AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) <> state AS crossing FROM s),
q AS (SELECT *, coalesce(lead(us) OVER w - us <= {20 * HOUR}, false) AS q FROM c WHERE crossing WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
p AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS p FROM q)
SELECT event_id, user_id, us, state FROM p WHERE NOT q AND NOT p"""


def best_view_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event with the highest value of each user and day; ties go to the smaller id."""
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(best.alias("b")).select("user_id", "day", "b.event_id", "b.value")


BESTVIEW_SQL = f"""WITH {EV}, r AS (SELECT *, us // {DAY} AS day, row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY value DESC, event_id) AS rn FROM ev) SELECT user_id, day, event_id, value FROM r WHERE rn = 1"""


def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed curve (mean of the last three values) and whether it has made no new maximum for ten rows."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    ev = events(spark, sf_dir).withColumn("cents", F.expr("cast(round(value * 100) as bigint)")).withColumn("n3", F.count("*").over(w.rowsBetween(-2, 0)))
    ev = ev.withColumn("s6", F.sum("cents").over(w.rowsBetween(-2, 0)) * 6 / F.col("n3")).withColumn("s6", F.col("s6").cast("bigint"))
    return ev.select("event_id", "s6", (F.max("s6").over(w.rowsBetween(-9, 0)) < F.max("s6").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("flat"))


PLATEAU_SQL = f"""WITH {EV}, c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM ev), s AS (SELECT *, CAST(sum(cents) OVER w * 6 // count(*) OVER w AS BIGINT) AS s6 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT event_id, s6, max(s6) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) < max(s6) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS flat FROM s"""


QUERIES = {
    "visits_hysteresis": (visits_hysteresis, VISITS_SQL),
    "crossings_runs": (crossings_runs, CROSSINGS_SQL),
    "debounce_state": (debounce_state, DEBOUNCE_SQL),
    "majority_smooth": (majority_smooth, MAJORITY_SQL),
    "median5_zero_pad": (median5_zero_pad, MEDIAN5_SQL),
    "look_jumps": (look_jumps, JUMPS_SQL),
    "interval_union": (interval_union, UNION_SQL),
    "sessions_gap": (sessions_gap, SESSIONS_SQL),
    "presence_blocks": (presence_blocks, PRESENCE_SQL),
    "id_switches": (id_switches, SWITCHES_SQL),
    "break_classes": (break_classes, BREAKS_SQL),
    "causal_features": (causal_features, CAUSAL_SQL),
    "pre_post_windows": (pre_post_windows, PREPOST_SQL),
    "gap_fill": (gap_fill, GAPFILL_SQL),
    "rle_timeline": (rle_timeline, RLE_SQL),
    "windows_ten_minutes": (windows_ten_minutes, WINDOWS_SQL),
    "undither": (undither, UNDITHER_SQL),
    "best_view_per_slice": (best_view_per_slice, BESTVIEW_SQL),
    "plateau": (plateau, PLATEAU_SQL),
}
