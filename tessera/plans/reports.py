"""Reports and views built from the operators, sources as queries, and streams held against their batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, intervals, neighbours, scratch, spacing
from ..sources import events, read_table
from ..streaming import folds, replay
from .event_sequences import DAY, EV, HOUR, MINUTE, SIDE
from .reviews import _ALL_BEFORE, _SESSIONS, CENTS, _cents, _sessions


# --- vectors ---------------------------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")


_UNIT = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e),
d AS (SELECT a.vec_id, b.vec_id AS other, a.label, b.label AS olabel, CAST(floor((1 - list_dot_product(a.v, b.v) / (a.size * b.size)) * 1e6 + 0.5) AS BIGINT) AS d FROM u a JOIN u b ON a.vec_id {} b.vec_id)"""


def knn_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: how many different labels its 20 nearest others have, and how many of them share its own."""
    vectors = _vectors(spark, sf_dir)
    near = neighbours.nearest_vectors(vectors, "vec_id", "embedding", "label", 20).withColumnRenamed("label", "olabel").join(vectors.select("vec_id", "label"), "vec_id")
    return near.groupBy("vec_id").agg(F.count_distinct("olabel").alias("labels"), F.count_if(F.expr("olabel = label")).alias("own"))


KNN_SQL = f"""WITH {_UNIT.format('<>')}, r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) <= 20)
SELECT vec_id, count(DISTINCT olabel) AS labels, count(*) FILTER (olabel = label) AS own FROM r GROUP BY vec_id"""


def pair_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors, same and different label: counts, the gate that lets 2 % and 1 % of the different ones pass, the same ones kept by each, and the AUC."""
    hist = neighbours.distance_histogram(_vectors(spark, sf_dir), "vec_id", "embedding", "label")
    by_d = scratch.cut(hist.groupBy("d").agg(F.sum(F.expr("CASE WHEN same THEN n ELSE 0 END")).alias("s"), F.sum(F.expr("CASE WHEN same THEN 0 ELSE n END")).alias("f")), "pair-histogram")
    w = Window.orderBy("d")  # one row for each distance: at most 2,000,001
    run = by_d.withColumn("cs", F.sum("s").over(w.rowsBetween(*_ALL_BEFORE))).withColumn("cf", F.sum("f").over(w.rowsBetween(*_ALL_BEFORE)))
    total = by_d.agg(F.sum("s").alias("same"), F.sum("f").alias("different"))
    met = run.crossJoin(F.broadcast(total))  # one row
    gate = lambda pct, what: F.max(F.expr(f"CASE WHEN cf * 100 <= different * {pct} THEN {what} END"))
    auc = F.sum(F.expr("CAST(s AS DOUBLE) * (2 * (different - cf) + f)")) / F.max(F.expr("2D * same * different"))
    return met.agg(F.max("same").alias("same"), F.max("different").alias("different"), gate(2, "d").alias("gate2"), gate(2, "cs").alias("kept2"), gate(1, "d").alias("gate1"), gate(1, "cs").alias("kept1"), F.round(auc, 9).alias("auc"))


PAIR_SQL = f"""WITH {_UNIT.format('<')}, h AS (SELECT d, count(*) FILTER (label = olabel) AS s, count(*) FILTER (label <> olabel) AS f FROM d GROUP BY d),
r AS (SELECT *, CAST(sum(s) OVER w AS BIGINT) AS cs, CAST(sum(f) OVER w AS BIGINT) AS cf, CAST(sum(s) OVER () AS BIGINT) AS same, CAST(sum(f) OVER () AS BIGINT) AS different FROM h WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT max(same) AS same, max(different) AS different, max(CASE WHEN cf * 100 <= different * 2 THEN d END) AS gate2, max(CASE WHEN cf * 100 <= different * 2 THEN cs END) AS kept2,
max(CASE WHEN cf * 100 <= different THEN d END) AS gate1, max(CASE WHEN cf * 100 <= different THEN cs END) AS kept1, round(sum(CAST(s AS DOUBLE) * (2 * (different - cf) + f)) / max(2.0::DOUBLE * same * different), 9) AS auc FROM r"""


# --- graph -----------------------------------------------------------------------------------------------------------
def relation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"Same" statements (a nation's customers and suppliers with equal key) make groups; per group its size and the "different" ones that contradict it."""
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    same = nations.where("n % 3 <> 0 and n < 24").select(F.col("n").alias("a"), F.expr("n + 1").alias("b"))
    roots = nations.join(graph.components(same).withColumnRenamed("node", "n"), "n", "left").select("n", F.coalesce("root", "n").alias("root"))
    apart = nations.where("n % 4 = 1").select("n", F.expr("(n + 2) % 25").alias("other"))
    bad = apart.join(roots, "n").join(roots.select(F.col("n").alias("other"), F.col("root").alias("oroot")), "other").where("root = oroot").groupBy("root").agg(F.count("*").alias("conflicts"))
    return roots.groupBy("root").agg(F.count("*").alias("size")).join(bad, "root", "left").select("root", "size", F.coalesce("conflicts", F.lit(0)).cast("bigint").alias("conflicts"))


CONFLICT_SQL = """WITH RECURSIVE same AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) + 1 AS b FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey < 24), e AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
reach(n, r) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n), roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n),
bad AS (SELECT x.root, count(*) AS conflicts FROM roots x JOIN roots y ON y.n = (x.n + 2) % 25 AND x.root = y.root WHERE x.n % 4 = 1 GROUP BY x.root)
SELECT root, count(*) AS size, coalesce(max(conflicts), 0) AS conflicts FROM roots LEFT JOIN bad USING (root) GROUP BY root"""


# --- views -----------------------------------------------------------------------------------------------------------
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline of runs decoded to its ticks: for each session every minute with its number and the run's share of it in thousandths."""
    ticks = F.expr(f"sequence(start, end, {MINUTE})")
    return _sessions(spark, sf_dir).where("n >= 2").select("user_id", "start", "end", F.posexplode(ticks).alias("tick", "us")).select("user_id", "us", F.col("tick").cast("bigint").alias("tick"), F.expr("(us - start) * 1000 div greatest(end - start, 1)").alias("share"))


DECODE_SQL = f"""WITH {_SESSIONS}, t AS (SELECT user_id, start, "end", unnest(range(start, "end" + 1, {MINUTE})) AS us FROM sess WHERE n >= 2)
SELECT user_id, us, (us - start) // {MINUTE} AS tick, (us - start) * 1000 // greatest("end" - start, 1) AS share FROM t"""


def watched_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: valid spans (an hour after each event of value over 1), their raw total and the total of their union."""
    spans = events(spark, sf_dir).where("value > 1").select("user_id", F.col("us").alias("start"), F.expr(f"us + {HOUR}").alias("stop"))
    union = intervals.interval_union(spans, ["user_id"], "start", "stop")
    return union.groupBy("user_id").agg(F.sum("n").alias("spans"), F.sum(F.expr("stop - start")).alias("union_us")).withColumn("raw_us", F.expr(f"spans * {HOUR}"))


WATCHED_SQL = f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {HOUR} THEN 0 ELSE 1 END AS new, lead(us) OVER w AS nxt FROM ev WHERE value > 1 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, count(*) AS spans, CAST(sum(CASE WHEN nxt IS NULL THEN {HOUR} ELSE least(nxt - us, {HOUR}) END) AS BIGINT) AS union_us, count(*) * {HOUR} AS raw_us FROM g GROUP BY user_id"""


def type_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length trace of one person: the types of each user in time order with the length of every run."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))
    runs = events(spark, sf_dir).withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(*_ALL_BEFORE)))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.min("us").alias("start"), F.count("*").alias("n"))


TRACE_SQL = f"""WITH {EV}, r AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r) SELECT user_id, run, min(event_type) AS event_type, min(us) AS start, count(*) AS n FROM s GROUP BY user_id, run"""


def why_not_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive sessions of a user: the gap, the jump in value, and the first rule that kept them apart."""
    made = intervals.sessions(_cents(spark, sf_dir), ["user_id"], "us", 30 * MINUTE, F.min_by("cents", F.struct("us", "event_id")).alias("c0"), F.max_by("cents", F.struct("us", "event_id")).alias("c1"))
    w = Window.partitionBy("user_id").orderBy("start")
    pairs = made.select("user_id", "start", (F.col("start") - F.lag("end").over(w)).alias("gap_us"), F.abs(F.col("c0") - F.lag("c1").over(w)).alias("jump")).where("gap_us is not null")
    return pairs.withColumn("reason", F.expr(f"CASE WHEN gap_us > {12 * HOUR} THEN 'long gap' WHEN jump > 5000 THEN 'jump' WHEN gap_us > {2 * HOUR} THEN 'gap' ELSE 'close' END"))


WHY_SQL = f"""WITH {_SESSIONS.replace('SELECT event_id, user_id, event_type, value,', 'SELECT event_id, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents,')},
t AS (SELECT user_id, min(us) AS start, max(us) AS stop, arg_min(cents, (us, event_id)) AS c0, arg_max(cents, (us, event_id)) AS c1 FROM i GROUP BY user_id, island),
p AS (SELECT user_id, start, start - lag(stop) OVER w AS gap_us, abs(c0 - lag(c1) OVER w) AS jump FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start))
SELECT *, CASE WHEN gap_us > {12 * HOUR} THEN 'long gap' WHEN jump > 5000 THEN 'jump' WHEN gap_us > {2 * HOUR} THEN 'gap' ELSE 'close' END AS reason FROM p WHERE gap_us IS NOT NULL"""


def truth_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as crossings with a neutral class, per day: entries, exits, neutral ones, and the most that were inside at once."""
    side = events(spark, sf_dir).withColumn("side", F.coalesce(F.expr(SIDE), F.lit(0))).withColumn("day", F.expr(f"us div {DAY}"))
    inside = side.withColumn("inside", F.sum("side").over(Window.partitionBy("day").orderBy("us", "event_id").rowsBetween(*_ALL_BEFORE)))
    return inside.groupBy("day").agg(F.count_if(F.expr("side = 1")).alias("entries"), F.count_if(F.expr("side = -1")).alias("exits"), F.count_if(F.expr("side = 0")).alias("neutral"), F.max("inside").alias("most"))


TRUTH_SQL = f"""WITH {EV}, s AS (SELECT *, us // {DAY} AS day, coalesce({SIDE}, 0) AS side FROM ev), i AS (SELECT *, sum(side) OVER (PARTITION BY day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS inside FROM s)
SELECT day, count(*) FILTER (side = 1) AS entries, count(*) FILTER (side = -1) AS exits, count(*) FILTER (side = 0) AS neutral, CAST(max(inside) AS BIGINT) AS most FROM i GROUP BY day"""


def world_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds cut anew: a segment ends at a signup or after a gap of 6 hours."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.expr(f"CASE WHEN event_type = 'signup' OR before IS NULL OR us - before > {6 * HOUR} THEN 1 ELSE 0 END")
    cut = events(spark, sf_dir).withColumn("before", F.lag("us").over(w)).withColumn("new", new).withColumn("segment", F.sum("new").over(w.rowsBetween(*_ALL_BEFORE)))
    return cut.groupBy("user_id", "segment").agg(F.min("us").alias("start"), F.max("us").alias("stop"), F.count("*").alias("n"))


WORLD_SQL = f"""WITH {EV}, n AS (SELECT *, CASE WHEN event_type = 'signup' OR lag(us) OVER w IS NULL OR us - lag(us) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM n) SELECT user_id, segment, min(us) AS start, max(us) AS stop, count(*) AS n FROM s GROUP BY user_id, segment"""


def testset_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test set of hours per day: the three busiest and three by hash order, marked by how they were picked."""
    hours = events(spark, sf_dir).groupBy(F.expr(f"us div {DAY}").alias("day"), F.expr(f"us div {HOUR}").alias("hour")).agg(F.count("*").alias("n"))
    busy = hours.withColumn("b", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "hour")))
    drawn = busy.withColumn("h", F.row_number().over(Window.partitionBy("day", F.expr("b <= 3")).orderBy(F.expr("md5(CAST(hour AS STRING))"), "hour")))
    return drawn.where("b <= 3 or h <= 3").selectExpr("day", "hour", "n", "CASE WHEN b <= 3 THEN 'busy' ELSE 'drawn' END AS picked")


TESTSET_SQL = f"""WITH {EV}, h AS (SELECT us // {DAY} AS day, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, hour) AS b FROM h),
d AS (SELECT *, row_number() OVER (PARTITION BY day, b <= 3 ORDER BY md5(CAST(hour AS VARCHAR)), hour) AS h FROM b) SELECT day, hour, n, CASE WHEN b <= 3 THEN 'busy' ELSE 'drawn' END AS picked FROM d WHERE b <= 3 OR h <= 3"""


def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the number of sessions moves with the gap and with every second or third event left out."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("stride")).where("event_id % stride = 0")
    step = e.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("stride", "user_id").orderBy("us", "event_id")))
    cut = step.select("stride", "gap", F.explode(F.array(*map(F.lit, (10, 30, 120)))).alias("minutes"))
    return cut.groupBy("stride", "minutes").agg(F.count_if(F.expr(f"gap IS NULL OR gap > minutes * {MINUTE}L")).alias("sessions"), F.count("*").alias("n"))


SWEEP_SQL = f"""WITH {EV}, e AS (SELECT user_id, us, event_id, unnest([1, 2, 3]) AS stride FROM ev), s AS (SELECT stride, us - lag(us) OVER (PARTITION BY stride, user_id ORDER BY us, event_id) AS gap FROM e WHERE event_id % stride = 0),
c AS (SELECT *, unnest([10, 30, 120]) AS minutes FROM s) SELECT stride, minutes, count(*) FILTER (gap IS NULL OR gap > CAST(minutes AS BIGINT) * {MINUTE}) AS sessions, count(*) AS n FROM c GROUP BY stride, minutes"""


def missed_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a purchase had no view within 15 minutes: one within an hour (timing), any event of the user that hour (broken), else nobody."""
    w = Window.partitionBy("user_id").orderBy("us")
    near = lambda what, span: F.coalesce(F.sum(F.expr(what)).over(w.rangeBetween(-span, span)), F.lit(0))
    view = "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END"
    seen = events(spark, sf_dir).withColumn("close", near(view, 15 * MINUTE)).withColumn("far", near(view, HOUR)).withColumn("any", near("1", HOUR)).where("event_type = 'purchase' and close = 0")
    return seen.selectExpr("event_id", "CASE WHEN far > 0 THEN 'timing' WHEN any > 1 THEN 'broken' ELSE 'nobody' END AS cause")


MISSED_SQL = f"""WITH {EV}, s AS (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {15 * MINUTE} PRECEDING AND {15 * MINUTE} FOLLOWING) AS close,
count(*) FILTER (event_type = 'view') OVER h AS far, count(*) OVER h AS around FROM ev WINDOW h AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING))
SELECT event_id, CASE WHEN far > 0 THEN 'timing' WHEN around > 1 THEN 'broken' ELSE 'nobody' END AS cause FROM s WHERE event_type = 'purchase' AND close = 0"""


def crop_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a user are cropped: each of the first five, every fourth up to the 40th, every tenth after, thirty at most."""
    aged = events(spark, sf_dir).withColumn("age", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))).where("age <= 5 or (age <= 40 and age % 4 = 0) or age % 10 = 0")
    return aged.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("age"))).where("nth <= 30").selectExpr("event_id", "CAST(age AS BIGINT) AS age")


CADENCE_SQL = f"""WITH {EV}, a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS age FROM ev)
SELECT event_id, age FROM a WHERE age <= 5 OR (age <= 40 AND age % 4 = 0) OR age % 10 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY age) <= 30"""


def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail a check, by check: exact integer zone, finite value, known kind, ordered dates."""
    flags = {"zone": "NOT props RLIKE '^[{]\"k\": [0-9]+[}]$'", "value": "value IS NULL OR isnan(value) OR abs(value) > 1e6", "kind": "event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')", "dates": "us < 0"}
    return events(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(F.expr(e)).alias(c) for c, e in flags.items()])


FLAGS_SQL = f"""WITH {EV} SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(props, '^[{{]"k": [0-9]+[}}]$')) AS zone, count(*) FILTER (value IS NULL OR isnan(value) OR abs(value) > 1e6) AS value,
count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')) AS kind, count(*) FILTER (us < 0) AS dates FROM ev"""


def segment_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as segments of a host: number from the address, gaps to the next one of the host in number order."""
    parsed = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.expr("CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT)").alias("number"))
    nxt = F.lead("number").over(Window.partitionBy("host").orderBy(F.col("number").asc_nulls_last(), "page_id"))
    return parsed.select("page_id", "host", "number", (nxt - F.col("number")).alias("gap"))


CATALOGUE_SQL = """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM pages)
SELECT *, lead(number) OVER (PARTITION BY host ORDER BY number NULLS LAST, page_id) - number AS gap FROM p"""


def log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of every user's log: its last 20 rows, the zone read from the text, and rows an hour over the last 24 hours there."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-24 * HOUR, 0)
    tail = events(spark, sf_dir).withColumn("rate", F.count("*").over(w)).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))).where("r <= 20")
    return tail.select("event_id", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)").alias("zone"), F.col("rate").alias("in_day"))


LOG_SQL = f"""WITH {EV}, t AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS in_day, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM ev)
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS zone, in_day FROM t WHERE r <= 20"""


def doubtful_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments to slow down at: where a session of a shop (50 users) begins or ends, the first of those within 10 minutes of the last one kept."""
    spans = _sessions(spark, sf_dir)
    moments = spans.select(F.expr("user_id div 50").alias("shop"), F.explode(F.array("start", "end")).alias("us"))
    return spacing.first_of_close(moments, ["shop"], "us", 10 * MINUTE)


MOMENTS_SQL = f"""WITH RECURSIVE {_SESSIONS}, t AS (SELECT user_id // 50 AS shop, min(us) AS a, max(us) AS b FROM i GROUP BY user_id, island), m AS (SELECT DISTINCT shop, unnest([a, b]) AS us FROM t),
kept AS (SELECT shop, min(us) AS us FROM m GROUP BY shop UNION ALL SELECT shop, us FROM (SELECT k.shop, min(m.us) AS us FROM kept k JOIN m ON m.shop = k.shop AND m.us > k.us + {10 * MINUTE} GROUP BY k.shop))
SELECT shop, us FROM kept"""


# --- streams ---------------------------------------------------------------------------------------------------------
LATE, BATCHES = "30 minutes", 4


def _replayed(spark: SparkSession, sf_dir: str, shape) -> DataFrame:
    """What a stream makes of the event log, its rows up to 29 minutes late and dealt to several batches."""
    return replay.replayed(events(spark, sf_dir), lambda s: shape(s.withColumn("vote", F.expr(f"(({SIDE}) + 1) div 2").cast("int"))), "us", "event_id", BATCHES, 29 * MINUTE)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 30 minutes every 5, written once the watermark has passed them: events and users (as a sum of ids) of each."""
    shape = lambda s: s.withWatermark("ts", LATE).groupBy(F.window("ts", "30 minutes", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("ids")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "ids")
    return _replayed(spark, sf_dir, shape).where("event_type is not null")


SLIDING_SQL = f"""WITH {EV}, w AS (SELECT *, us // {5 * MINUTE} * {5 * MINUTE} - k * {5 * MINUTE} AS start_us FROM ev, (SELECT unnest(range(6)) AS k))
SELECT start_us, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS ids FROM w GROUP BY start_us, event_type"""


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour, written once the watermark has passed them."""
    shape = lambda s: s.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("event_id").alias("n"), F.max("event_id").alias("last")).select(F.unix_micros("w.start").alias("start_us"), "n", "last")
    return _replayed(spark, sf_dir, shape).where("n > 0")


TUMBLING_SQL = f"WITH {EV} SELECT us // {HOUR} * {HOUR} AS start_us, count(*) AS n, max(event_id) AS last FROM ev GROUP BY us // {HOUR}"


def stream_first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated work in a stream: the pairs (user, type) that came through.

    The stream keeps one result a pair and hour, with state for the last hour and the watermark only; what repeats over hours
    is made one in the table that it has written.
    """
    shape = lambda s: s.withColumn("hour", F.date_trunc("hour", "ts")).withWatermark("hour", "90 minutes").dropDuplicates(["user_id", "event_type", "hour"]).select("user_id", "event_type")
    return _replayed(spark, sf_dir, shape).where("user_id is not null").distinct()


RESULTS_SQL = "SELECT DISTINCT user_id, event_type FROM events"


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's side flips when seven tenths of at least three votes of the last six hours say so; the flip, and when the new side began."""
    fold = folds.Debounce(6 * HOUR, 7, 3, HOUR)
    shape = lambda s: folds.stream_fold(s, "user_id", "ts", "us", "event_id", ["vote"], fold, "at bigint, side int, began bigint", LATE)
    return folds.finals(_replayed(spark, sf_dir, shape)).where("user_id is not null")


STREAM_DEBOUNCE_SQL = f"""WITH {EV}, v AS (SELECT *, (({SIDE}) + 1) // 2 AS vote FROM ev),
n AS (SELECT *, count(vote) OVER p AS n, sum(vote) OVER p AS ones, min(us) OVER p AS low, min(CASE WHEN vote = 1 THEN us END) OVER p AS one, min(CASE WHEN vote = 0 THEN us END) OVER p AS nil FROM v
  WINDOW p AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)),
d AS (SELECT DISTINCT user_id, us, CASE WHEN ones * 10 >= n * 7 THEN 1 ELSE 0 END AS side, CASE WHEN ones * 10 >= n * 7 THEN one ELSE nil END AS began FROM n WHERE n >= 3 AND us - low >= {HOUR} AND (ones * 10 >= n * 7 OR (n - ones) * 10 >= n * 7)),
f AS (SELECT *, lag(side) OVER (PARTITION BY user_id ORDER BY us) AS before FROM d)
SELECT user_id, us AS at, side, began FROM f WHERE before <> side"""


def stream_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches inside from crossings (views and clicks go in, purchases and signups out), joined again within 3 hours, closed by timers."""
    fold = folds.Stretches(3 * HOUR, 20 * MINUTE)
    kind = F.when(F.col("vote") == 1, "in").when(F.col("vote") == 0, "out")
    shape = lambda s: folds.stream_fold(s.withColumn("kind", kind).where("kind is not null or event_id is null"), "user_id", "ts", "us", "event_id", ["kind"], fold, "start bigint, stop bigint, complete boolean", LATE)
    return folds.finals(_replayed(spark, sf_dir, shape)).where("user_id is not null")


STRETCHES_SQL = f"""WITH {EV}, c AS (SELECT *, CASE WHEN {SIDE} = 1 THEN 1 WHEN {SIDE} = -1 THEN 0 END AS inward FROM ev), x AS (SELECT * FROM c WHERE inward IS NOT NULL),
p AS (SELECT *, lag(inward) OVER w AS before, lag(us) OVER w AS before_us FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, count(*) FILTER (before IS NULL OR (before = 0 AND us - before_us > {3 * HOUR})) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM p),
g AS (SELECT user_id, part, min(us) FILTER (inward = 1) AS start, max(us) FILTER (inward = 0) AS stop, arg_max(inward, (us, event_id)) AS ends FROM s GROUP BY user_id, part)
SELECT user_id, start, stop, start IS NOT NULL AS complete FROM g WHERE ends = 0 AND (start IS NULL OR stop - start >= {20 * MINUTE})"""


WORLD = {"hidden": 2 * DAY, "same": 0.9, "staff": 60}


def sightings(log: DataFrame) -> DataFrame:
    """``log`` with place (a sixth of the users), track (a user's day) and look, which follows from the user and the event's value."""
    look = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.pmod(F.xxhash64("user_id", k), F.lit(2001)) - 1000 + F.col("value") * F.lit(0.05))
    return log.withColumn("place", F.pmod("user_id", F.lit(6))).withColumn("track", F.expr(f"concat(user_id, '-', us div {DAY})")).withColumn("look", F.when(F.col("user_id").isNotNull(), look))


def stream_world_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a place from sightings, kept by a stream that forgets whom it hasn't seen for two days, but for the staff."""
    shape = lambda s: folds.stream_fold(sightings(s), "place", "ts", "us", "event_id", ["track", "look"], folds.WorldPeople("event_id", **WORLD), "sight bigint, at bigint, person bigint", LATE)
    return folds.finals(_replayed(spark, sf_dir, shape)).where("place is not null")


QUERIES = {
    "knn_distinct": (knn_distinct, KNN_SQL), "pair_calibration": (pair_calibration, PAIR_SQL), "relation_conflicts": (relation_conflicts, CONFLICT_SQL), "rle_decode": (rle_decode, DECODE_SQL), "watched_time": (watched_time, WATCHED_SQL),
    "type_trace": (type_trace, TRACE_SQL), "why_not_joined": (why_not_joined, WHY_SQL), "truth_views": (truth_views, TRUTH_SQL), "world_segments": (world_segments, WORLD_SQL), "testset_pick": (testset_pick, TESTSET_SQL),
    "gate_sweep": (gate_sweep, SWEEP_SQL), "missed_causes": (missed_causes, MISSED_SQL), "crop_cadence": (crop_cadence, CADENCE_SQL), "validation_flags": (validation_flags, FLAGS_SQL), "segment_catalogue": (segment_catalogue, CATALOGUE_SQL),
    "log_rates": (log_rates, LOG_SQL), "stream_sliding": (stream_sliding, SLIDING_SQL), "stream_tumbling": (stream_tumbling, TUMBLING_SQL), "doubtful_moments": (doubtful_moments, MOMENTS_SQL), "stream_first_results": (stream_first_results, RESULTS_SQL),
    "stream_debounce": (stream_debounce, STREAM_DEBOUNCE_SQL), "stream_stretches": (stream_stretches, STRETCHES_SQL), "stream_world_people": (stream_world_people, None),
}
