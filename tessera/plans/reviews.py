"""Joins between pieces, summaries of tracks and scores, overlay operations, sampling protocols and queues."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, nearby, overlay, pair_blocks
from ..operators.scratch import cut
from ..sources import events, read_table
from .event_sequences import _SESSION_CTE, DAY, EV, HOUR, MINUTE

_SESSIONS = _SESSION_CTE.replace("ORDER BY us RANGE UNBOUNDED PRECEDING", "ORDER BY us, event_id ROWS UNBOUNDED PRECEDING").replace("OVER (PARTITION BY user_id ORDER BY us)", "OVER (PARTITION BY user_id ORDER BY us, event_id)")
_ALL_BEFORE = (Window.unboundedPreceding, 0)


def _sessions(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return intervals.sessions(events(spark, sf_dir), ["user_id"], "us", 30 * MINUTE, *more)


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("cents", F.expr("CAST(round(value * 100) AS BIGINT)"))


CENTS = f"{EV}, k AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM ev)"


# --- joins -----------------------------------------------------------------------------------------------------------
def _always_apart(code, size, left, right):
    """Pairs that meet twice or more and whose values are over 2000 apart each time; unknown values aren't."""
    (low, high), (olow, ohigh) = left, right
    common = np.bincount(code, minlength=size)
    apart = ((low - ohigh > 2000) | (olow - high > 2000)) & (low != pair_blocks.NULL) & (olow != pair_blocks.NULL)
    near = np.bincount(code[~apart], minlength=size)
    pair = np.flatnonzero((common >= 2) & (near == 0))
    return pair, common[pair], common[pair]


def _ranges(low, high):
    """The whole numbers from each ``low`` to before its ``high``, one stretch after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def _apart_blocks(left, right, same):
    """As ``_always_apart``, a left user at a time: near meetings lie in stretches of an hour's values, so only codes are read."""
    lk, ls, low, high = (c[np.argsort(left[0], kind="stable")] for c in left)
    null = right[2] == pair_blocks.NULL
    odd = null | (right[2] != right[3])  # not one known value: compared one by one
    hours, rank = np.unique(right[1], return_inverse=True)
    points = right[2][~odd]
    least, most = (int(points.min()), int(points.max())) if len(points) else (0, 0)
    if most - least > 2**62 // (len(hours) + 1):
        yield from pair_blocks._pairs(left, right, same, _always_apart)
        return
    width = most - least + 3
    place = rank * width + np.where(odd, width - 1, right[2] - least + 1)
    order = np.argsort(place, kind="stable")
    place, null = place[order], null[order]
    keys, code = np.unique(right[0], return_inverse=True)
    code, olow, ohigh = code[order], right[2][order], right[3][order]
    # the hour's rows, its odd ones and the near stretch of each left row
    hour = np.minimum(np.searchsorted(hours, ls), len(hours) - 1)
    met, unknown = hours[hour] == ls, low == pair_blocks.NULL
    floor = np.where(unknown, least, np.clip(low, least - 9000, most + 9000)) - 2000
    ceil = np.where(unknown, most, np.clip(high, least - 9000, most + 9000)) + 2000
    asked = [hour * width, hour * width + np.clip(floor - least + 1, 0, width - 1), hour * width + np.clip(ceil - least + 2, 1, width - 1), hour * width + width - 1, (hour + 1) * width]
    by = np.argsort(asked[1], kind="stable")
    found = []
    for a in asked:
        at = np.zeros(len(ls), np.int64)
        at[by] = np.searchsorted(place, a[by], "left")
        found.append(np.where(met, at, 0))
    begin, near, near_end, others, end = found
    near_end = np.maximum(near, near_end)
    begins = np.flatnonzero(np.diff(lk, prepend=lk[0] - 1)) if len(lk) else np.empty(0, np.int64)
    out, n = [], 0
    for a, b in zip(begins, [*begins[1:], len(lk)], strict=True):
        common = np.bincount(np.concatenate([code[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)]), minlength=len(keys))
        good = common >= 2
        good[np.concatenate([code[x:y] for x, y in zip(near[a:b].tolist(), near_end[a:b].tolist(), strict=True)])] = False
        at, row = _ranges(others[a:b], end[a:b]), np.repeat(np.arange(a, b), end[a:b] - others[a:b])
        apart = ((low[row] - ohigh[at] > 2000) | (olow[at] - high[row] > 2000)) & ~unknown[row] & ~null[at]
        good[code[at[~apart]]] = False
        pair = np.flatnonzero(good)
        if same:
            pair = pair[keys[pair] > lk[a]]
        out.append((np.full(len(pair), lk[a]), keys[pair], common[pair]))
        n += len(pair)
        if n >= pair_blocks.MEETINGS // 4:
            yield from _ordered(out)
            out, n = [], 0
    if n:
        yield from _ordered(out)


def _ordered(parts):
    p, q, common = (np.concatenate(c) for c in zip(*parts, strict=True))
    yield np.minimum(p, q), np.maximum(p, q), common, common


def cannot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users that cannot be one person: seen in the same hour at least twice, values over 20 apart each time."""
    hourly = _cents(spark, sf_dir).groupBy("user_id", F.expr(f"us div {HOUR}").alias("hour")).agg(F.min("cents").alias("low"), F.max("cents").alias("high"))
    return pair_blocks.fold_pairs(hourly, "user_id", "hour", ["low", "high"], _always_apart, "user_id bigint, other bigint, common bigint, apart bigint", _apart_blocks)


CANNOT_SQL = f"""WITH {CENTS}, h AS (SELECT user_id, us // {HOUR} AS hour, min(cents) AS low, max(cents) AS high FROM k GROUP BY user_id, us // {HOUR})
SELECT a.user_id, b.user_id AS other, count(*) AS common, count(*) FILTER (a.low - b.high > 2000 OR b.low - a.high > 2000) AS apart FROM h a JOIN h b ON a.hour = b.hour AND a.user_id < b.user_id
GROUP BY a.user_id, b.user_id HAVING count(*) >= 2 AND count(*) FILTER (a.low - b.high > 2000 OR b.low - a.high > 2000) = count(*)"""


def neighbour_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sessions of different users within 5 minutes of each other, with the number of event types both show."""
    types = _sessions(spark, sf_dir, F.collect_set("event_type").alias("types")).select("user_id", "start", "end", "types")
    a = types.select(F.lit(0).alias("all"), "user_id", "start", F.expr(f"end + {5 * MINUTE}").alias("stop"), "types")
    b = types.select(F.lit(0).alias("all"), F.col("user_id").alias("other"), F.col("start").alias("ostart"), F.expr(f"end + {5 * MINUTE}").alias("ostop"), F.col("types").alias("otypes"))
    near = intervals.bucketed_overlap_join(a, b, ["all"], ("start", "stop"), ("ostart", "ostop"), 30 * MINUTE).where("user_id < other")
    return near.select("user_id", "start", "other", "ostart", F.size(F.array_intersect("types", "otypes")).cast("bigint").alias("shared"))


NEIGHBOUR_SQL = f"""WITH {_SESSIONS}, t AS (SELECT user_id, min(us) AS start, max(us) AS stop, list(DISTINCT event_type) AS types FROM i GROUP BY user_id, island)
SELECT a.user_id, a.start, b.user_id AS other, b.start AS ostart, CAST(len(list_intersect(a.types, b.types)) AS BIGINT) AS shared FROM t a JOIN t b
ON a.user_id < b.user_id AND a.start <= b.stop + {5 * MINUTE} AND b.start <= a.stop + {5 * MINUTE}"""


def seam_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across day borders: a user's last event of a day and the next day's first one, joined where both are the only candidates within 3 hours."""
    day = F.expr(f"us div {DAY}")
    ends = events(spark, sf_dir).withColumn("day", day).groupBy("user_id", "day").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    late = ends.where(f"(day + 1) * {DAY} - last <= {3 * HOUR}").select(F.expr("day + 1").alias("day"), F.expr("user_id % 41").alias("cam"), "user_id", "last")
    early = ends.where(f"first - day * {DAY} <= {3 * HOUR}").select("day", F.expr("user_id % 41").alias("cam"), F.col("user_id").alias("next"), "first")
    # all of a day and camera are each other's candidates, so a pair stands alone where either side has one row
    alone = lambda side, *columns: side.groupBy("day", "cam").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in columns]).where("n = 1").drop("n")
    return alone(late, "user_id", "last").join(alone(early, "next", "first"), ["day", "cam"]).select("day", "user_id", "next", F.expr("first - last").alias("gap_us"))


SEAM_SQL = f"""WITH {EV}, e AS (SELECT user_id, us // {DAY} AS day, min(us) AS first, max(us) AS last FROM ev GROUP BY user_id, us // {DAY}),
l AS (SELECT day + 1 AS day, user_id % 41 AS cam, user_id, last FROM e WHERE (day + 1) * {DAY} - last <= {3 * HOUR}), f AS (SELECT day, user_id % 41 AS cam, user_id AS next, first FROM e WHERE first - day * {DAY} <= {3 * HOUR}),
m AS (SELECT day, user_id, next, first - last AS gap_us, count(*) OVER (PARTITION BY day, cam, user_id) AS n1, count(*) OVER (PARTITION BY day, cam, next) AS n2 FROM l JOIN f USING (day, cam))
SELECT day, user_id, next, gap_us FROM m WHERE n1 = 1 AND n2 = 1"""


def break_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that begin up to 10 minutes after another user's session ended, with values at most 20 apart: the nearest end each."""
    at = F.expr("CASE WHEN cents IS NOT NULL THEN struct(us, event_id) END")
    made = intervals.sessions(_cents(spark, sf_dir), ["user_id"], "us", 30 * MINUTE, F.min_by("cents", at).alias("c0"), F.max_by("cents", at).alias("c1"))
    made = cut(made.select("user_id", "start", "end", "c0", "c1"), "pieces")
    # a user's own pieces lie over 30 minutes apart, so none is found for itself
    found = nearby.last_alike(made.selectExpr("user_id AS who", "end AS t", "c1 AS x"), made.selectExpr("user_id AS who", "start AS t", "c0 AS x"), 10 * MINUTE, 2000)
    return found.selectExpr("key AS user_id", "start", "before", "start - stop AS gap_us", "n")


BREAK_SQL = f"""WITH {_SESSIONS.replace('SELECT event_id, user_id, event_type, value,', 'SELECT event_id, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents,')},
t AS (SELECT user_id, min(us) AS start, max(us) AS stop, arg_min(cents, (us, event_id)) AS c0, arg_max(cents, (us, event_id)) AS c1 FROM i GROUP BY user_id, island),
m AS (SELECT a.user_id, a.start, b.user_id AS before, b.stop, row_number() OVER (PARTITION BY a.user_id, a.start ORDER BY b.stop DESC, b.user_id DESC) AS r, count(*) OVER (PARTITION BY a.user_id, a.start) AS n
 FROM t a JOIN t b ON a.user_id <> b.user_id AND a.start > b.stop AND a.start - b.stop <= {10 * MINUTE} AND abs(a.c0 - b.c1) <= 2000)
SELECT user_id, start, before, start - stop AS gap_us, n FROM m WHERE r = 1"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their sidecars by a composite key: supplier and part notes, the nation as the last resort."""
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    lines = read_table(spark, sf_dir, "lineitem").select(key.alias("key"), "l_partkey", "l_suppkey", F.expr("l_quantity > 25").alias("big"))
    part = read_table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), F.expr("CAST(p_size AS BIGINT)").alias("size"))
    supp = read_table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.expr("CAST(s_nationkey AS BIGINT)").alias("nation"))
    return lines.join(part, "l_partkey", "left").join(supp, "l_suppkey", "left").selectExpr("key", "coalesce(size, nation + 100, -1) AS note", "size IS NOT NULL AND big AS sized")


SIDECAR_SQL = """SELECT concat_ws('|', l_orderkey, l_linenumber) AS key, coalesce(CAST(p_size AS BIGINT), CAST(s_nationkey AS BIGINT) + 100, -1) AS note, p_size IS NOT NULL AND l_quantity > 25 AS sized
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) p ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = l_suppkey"""


def single_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for a floor fit: the same type in the same hour, exactly one event on the even and one on the odd users' side."""
    cam = _cents(spark, sf_dir).select("event_type", F.expr(f"us div {HOUR}").alias("hour"), F.expr("user_id % 2").alias("cam"), "cents")
    once = cam.groupBy("event_type", "hour", "cam").agg(F.count("*").alias("n"), F.min("cents").alias("cents")).where("n = 1")
    side = lambda k, c: once.where(f"cam = {k}").select("event_type", "hour", F.col("cents").alias(c))
    return side(0, "c0").join(side(1, "c1"), ["event_type", "hour"])


SINGLE_SQL = f"""WITH {CENTS}, o AS (SELECT event_type, us // {HOUR} AS hour, user_id % 2 AS cam, min(cents) AS cents FROM k GROUP BY event_type, us // {HOUR}, user_id % 2 HAVING count(*) = 1)
SELECT a.event_type, a.hour, a.cents AS c0, b.cents AS c1 FROM o a JOIN o b ON a.event_type = b.event_type AND a.hour = b.hour AND a.cam = 0 AND b.cam = 1"""


def membership_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to the suppliers of their lines: those that belong to several, and the group each unique one inherits."""
    own = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("owners"), F.min("l_suppkey").alias("owner"))
    supp = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.expr("CAST(s_nationkey AS BIGINT)").alias("grp"))
    return own.join(supp, "owner", "left").selectExpr("l_partkey", "owners", "CASE WHEN owners = 1 THEN grp END AS grp", "owners > 1 AS ambiguous")


BRIDGE_SQL = """WITH o AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS owner FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, owners, CASE WHEN owners = 1 THEN CAST(s_nationkey AS BIGINT) END AS grp, owners > 1 AS ambiguous FROM o LEFT JOIN supplier ON s_suppkey = owner"""


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer (an order's cheapest line) makes one pair "same" and one "different" for every other line that isn't the same part."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    chosen = lines.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("chosen"), F.min_by("l_partkey", F.struct("l_extendedprice", "l_linenumber")).alias("cpart"))
    met = lines.join(chosen, "l_orderkey").where("l_linenumber = chosen or l_partkey <> cpart")
    return met.selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS line", "l_linenumber = chosen AS same")


ANSWER_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber AS chosen, l_partkey AS cpart FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) = 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_linenumber = chosen AS same FROM lineitem JOIN c USING (l_orderkey) WHERE l_linenumber = chosen OR l_partkey <> cpart"""


# --- summaries -------------------------------------------------------------------------------------------------------
def stitch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much identities are cut: users, pieces (sessions) per user, share with more than one, median and p90."""
    per = _sessions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("people"), F.sum("n").alias("pieces"), F.count_if(F.expr("n > 1")).alias("cut"), F.median("n").alias("median"), F.percentile("n", 0.9).alias("p90"))


STITCH_SQL = f"""WITH {_SESSIONS}, p AS (SELECT user_id, count(*) AS n FROM sess GROUP BY user_id)
SELECT count(*) AS people, CAST(sum(n) AS BIGINT) AS pieces, count(*) FILTER (n > 1) AS cut, median(n) AS median, quantile_cont(n, 0.9) AS p90 FROM p"""


def tracker_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates from pairs: value steps of a user's next event within an hour (same) against other users in the same minute (different)."""
    k = _cents(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    same = k.withColumn("d", F.abs(F.col("cents") - F.lag("cents").over(w))).withColumn("gap", F.col("us") - F.lag("us").over(w)).where(f"gap <= {HOUR}").select(F.lit("same").alias("kind"), "d")
    minute = F.expr(f"us div {MINUTE}")
    b = k.select(minute.alias("m"), F.col("user_id").alias("other"), F.col("cents").alias("ocents"))
    rest = k.withColumn("m", minute).join(b, "m").where("user_id < other").select(F.lit("different").alias("kind"), F.abs(F.col("cents") - F.col("ocents")).alias("d"))
    return same.union(rest).groupBy("kind").agg(F.count("*").alias("n"), F.median("d").alias("median"), F.percentile("d", 0.02).alias("p02"), F.percentile("d", 0.98).alias("p98"))


GATES_SQL = f"""WITH {CENTS}, s AS (SELECT 'same' AS kind, abs(cents - lag(cents) OVER w) AS d, us - lag(us) OVER w AS gap FROM k WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT 'different' AS kind, abs(a.cents - b.cents) AS d FROM k a JOIN k b ON a.us // {MINUTE} = b.us // {MINUTE} AND a.user_id < b.user_id), u AS (SELECT kind, d FROM s WHERE gap <= {HOUR} UNION ALL SELECT * FROM d)
SELECT kind, count(*) AS n, median(d) AS median, quantile_cont(d, 0.02) AS p02, quantile_cont(d, 0.98) AS p98 FROM u GROUP BY kind"""


def robust_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: median purchase value if there are at least 5, median of all, share of clicks."""
    bought = F.expr("CASE WHEN event_type = 'purchase' THEN cents END")
    g = _cents(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count(bought).alias("bought"), F.median(bought).alias("m"), F.median("cents").alias("median"), F.count_if(F.expr("event_type = 'click'")).alias("clicks"))
    return g.selectExpr("user_id", "n", "CASE WHEN bought >= 5 THEN m END AS bought_median", "median", "clicks")


ROBUST_SQL = f"""WITH {CENTS} SELECT user_id, count(*) AS n, CASE WHEN count(*) FILTER (event_type = 'purchase') >= 5 THEN median(cents) FILTER (event_type = 'purchase') END AS bought_median, median(cents) AS median,
count(*) FILTER (event_type = 'click') AS clicks FROM k GROUP BY user_id"""


def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one person (ten users a person) in the same quarter of an hour as one: summed value, count, union of types."""
    tick = _cents(spark, sf_dir).groupBy(F.expr("user_id div 10").alias("person"), F.expr(f"us div {15 * MINUTE}").alias("tick"))
    return tick.agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("event_type"))).alias("types"))


MERGE_SQL = f"""WITH {CENTS} SELECT user_id // 10 AS person, us // {15 * MINUTE} AS tick, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types
FROM k GROUP BY user_id // 10, us // {15 * MINUTE}"""


def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a type within 20 minutes of each other as one: mean and largest of the values known (errors are unknown)."""
    known = _cents(spark, sf_dir).withColumn("c", F.expr("CASE WHEN props NOT LIKE '%: 0}' THEN cents END"))
    return intervals.sessions(known, ["event_type", "user_id"], "us", 20 * MINUTE, F.sum("c").alias("total"), F.count("c").alias("known"), F.max("c").alias("top"))


CLUSTER_SQL = f"""WITH {CENTS}, c AS (SELECT *, CASE WHEN props NOT LIKE '%: 0}}' THEN cents END AS c FROM k),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type, user_id ORDER BY us, event_id) <= {20 * MINUTE} THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type, user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT event_type, user_id, min(us) AS start, max(us) AS "end", count(*) AS n, CAST(sum(c) AS BIGINT) AS total, count(c) AS known, max(c) AS top FROM i GROUP BY event_type, user_id, island"""


def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flag: squared and absolute error of a price prediction (quantity times 1500) in whole units, and the rank correlation's sums."""
    lines = read_table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "CAST(floor(l_extendedprice) AS BIGINT) AS truth", "CAST(l_quantity * 1500 AS BIGINT) AS guess")
    counted = lambda c: lines.groupBy("flag", F.col(c).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("flag").orderBy("v").rowsBetween(*_ALL_BEFORE)
    ranks = lambda c: counted(c).withColumn("r", F.sum("n").over(w) * 2 - F.col("n") + 1).select("flag", F.col("v").alias(c), F.col("r").alias(f"r_{c}"))  # noqa: E731 (twice the mean rank)
    met = lines.join(ranks("truth"), ["flag", "truth"]).join(ranks("guess"), ["flag", "guess"])
    return met.groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.expr("CAST((truth - guess) * (truth - guess) AS DECIMAL(38, 0))")).cast("double").alias("sse"), F.sum(F.expr("abs(truth - guess)")).alias("sae"), F.corr("r_truth", "r_guess").alias("spearman")).withColumn("spearman", F.round("spearman", 6))


REGRESSION_SQL = """WITH l AS (SELECT l_returnflag AS flag, CAST(floor(l_extendedprice) AS BIGINT) AS truth, CAST(l_quantity * 1500 AS BIGINT) AS guess FROM lineitem),
r AS (SELECT *, 2 * rank() OVER (PARTITION BY flag ORDER BY truth) + count(*) OVER (PARTITION BY flag, truth) - 1 AS rt, 2 * rank() OVER (PARTITION BY flag ORDER BY guess) + count(*) OVER (PARTITION BY flag, guess) - 1 AS rg FROM l)
SELECT flag, count(*) AS n, CAST(sum(CAST((truth - guess) * (truth - guess) AS HUGEINT)) AS DOUBLE) AS sse, CAST(sum(abs(truth - guess)) AS BIGINT) AS sae, round(corr(rt, rg), 6) AS spearman FROM r GROUP BY flag"""


def zero_false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: the highest score (length) of a document to keep, and how many to remove lie above it."""
    lab = read_table(spark, sf_dir, "labels").where("quality is not null").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("CAST(n_chars AS BIGINT)").alias("score")), "doc_id")
    top = lab.groupBy("lang").agg(F.max(F.expr("CASE WHEN quality = 1 THEN score END")).alias("cut"))
    met = lab.join(top, "lang").groupBy("lang").agg(F.max("cut").alias("cut"), F.count_if(F.expr("quality = 0")).alias("bad"), F.count_if(F.expr("quality = 0 and score > cut")).alias("caught"))
    return met


ZERO_SQL = """WITH l AS (SELECT lang, quality, CAST(n_chars AS BIGINT) AS score FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT lang, max(CASE WHEN quality = 1 THEN score END) AS cut FROM l GROUP BY lang)
SELECT lang, max(cut) AS cut, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND score > cut) AS caught FROM l JOIN t USING (lang) GROUP BY lang"""


def model_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per discount: the residuals of a shift and of a line between quantity and price, from sums."""
    xy = read_table(spark, sf_dir, "lineitem").selectExpr("CAST(round(l_discount * 100) AS BIGINT) AS model", "CAST(l_quantity AS BIGINT) AS x", "CAST(floor(l_extendedprice / 1000) AS BIGINT) AS y")
    sums = xy.groupBy("model").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(c) for c, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"), ("syy", "y * y"))])
    return sums.selectExpr("model", "n", f"{_SHIFT} AS shift", f"{_LINE} AS line")


# n times the residual sums, whole numbers up to the last division
_SHIFT = "round((n * (syy + sxx - 2 * sxy) - (sy - sx) * (sy - sx)) / CAST(n AS DOUBLE), 3)"
_LINE = "round(((n * syy - sy * sy) - CAST((n * sxy - sx * sy) AS DOUBLE) * (n * sxy - sx * sy) / (n * sxx - sx * sx)) / n, 3)"
FITS_SQL = f"""WITH xy AS (SELECT CAST(round(l_discount * 100) AS BIGINT) AS model, CAST(l_quantity AS BIGINT) AS x, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS y FROM lineitem),
s AS (SELECT model, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(y * y) AS BIGINT) AS syy FROM xy GROUP BY model)
SELECT model, n, {_SHIFT} AS shift, {_LINE} AS line FROM s"""


def span_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of every quarter of an hour: users, 3 for each with several types, motion by the value range."""
    per = _cents(spark, sf_dir).groupBy(F.expr(f"us div {15 * MINUTE}").alias("span"), "user_id").agg(F.count_distinct("event_type").alias("types"), F.max("cents").alias("high"), F.min("cents").alias("low"))
    return per.groupBy("span").agg(F.count("*").alias("people"), (F.count("*") + 3 * F.count_if(F.expr("types > 1")) + F.expr("(max(high) - min(low)) div 5000")).alias("activity"))


ACTIVITY_SQL = f"""WITH {CENTS}, p AS (SELECT us // {15 * MINUTE} AS span, user_id, count(DISTINCT event_type) AS types, max(cents) AS high, min(cents) AS low FROM k GROUP BY us // {15 * MINUTE}, user_id)
SELECT span, count(*) AS people, count(*) + 3 * count(*) FILTER (types > 1) + (max(high) - min(low)) // 5000 AS activity FROM p GROUP BY span"""


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, days and types in the log, by type and over all."""
    e = events(spark, sf_dir).withColumn("day", F.expr(f"us div {DAY}"))
    return e.rollup("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("day").alias("days"), F.count("*").alias("n"))


DISTINCT_SQL = f"WITH {EV} SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT us // {DAY}) AS days, count(*) AS n FROM ev GROUP BY ROLLUP (event_type)"


# --- sequences -------------------------------------------------------------------------------------------------------
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's strongest change: where the medians of 5 values before and from there on differ most, if by 20 or more."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    five = lambda a, b: F.sort_array(F.collect_list("cents").over(w.rowsBetween(a, b)))
    moved = _cents(spark, sf_dir).withColumn("b", five(-5, -1)).withColumn("a", five(0, 4)).where("size(a) = 5 and size(b) = 5").withColumn("jump", F.expr("abs(a[2] - b[2])")).where("jump >= 2000")
    return moved.groupBy("user_id").agg(F.max_by("event_id", F.struct("jump", F.expr("-us"), F.expr("-event_id"))).alias("event_id"), F.max("jump").alias("jump"))


CHANGE_SQL = f"""WITH {CENTS}, w AS (SELECT user_id, us, event_id, list_sort(list(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS b,
 list_sort(list(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS a FROM k)
SELECT user_id, event_id, abs(a[3] - b[3]) AS jump FROM w WHERE len(a) = 5 AND len(b) = 5 AND abs(a[3] - b[3]) >= 2000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(a[3] - b[3]) DESC, us, event_id) = 1"""


def best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's best cut in two over all prefixes: the largest gain of squared sums; sessions (3 hours) of at least 4 events."""
    made = intervals.islands(_cents(spark, sf_dir).withColumn("stop", F.col("us")), ["user_id"], "us", "stop", 3 * HOUR, ["event_id"])
    w = Window.partitionBy("user_id", "island").orderBy("us", "event_id")
    whole = Window.partitionBy("user_id", "island")
    cut = made.withColumn("n1", F.row_number().over(w)).withColumn("s1", F.sum("cents").over(w.rowsBetween(*_ALL_BEFORE))).withColumn("n", F.count("*").over(whole)).withColumn("s", F.sum("cents").over(whole)).where("n >= 4 and n1 < n")
    gain = F.expr("(s1 * n - s * n1) * (s1 * n - s * n1) div (n1 * (n - n1))")
    best = cut.withColumn("gain", gain).groupBy("user_id", "island").agg(F.max(F.struct("gain", F.expr("-n1").alias("k"))).alias("m"), F.min("n").alias("n"))
    return best.selectExpr("user_id", "island", "n", "CAST(-m.k AS BIGINT) AS cut", "m.gain AS gain")


SPLIT_SQL = f"""WITH {CENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {3 * HOUR} THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g),
c AS (SELECT user_id, island, row_number() OVER w AS n1, CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s1, count(*) OVER (PARTITION BY user_id, island) AS n, CAST(sum(cents) OVER (PARTITION BY user_id, island) AS BIGINT) AS s FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY us, event_id)),
v AS (SELECT *, (s1 * n - s * n1) * (s1 * n - s * n1) // (n1 * (n - n1)) AS gain FROM c WHERE n >= 4 AND n1 < n)
SELECT user_id, island, n, n1 AS cut, gain FROM v QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY gain DESC, n1) = 1"""


def two_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that turns on when the mean of the last 3 values passes 60 and off below 30; its changes per user."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    voted = _cents(spark, sf_dir).withColumn("s", F.sum("cents").over(w.rowsBetween(-2, 0))).withColumn("m", F.count("*").over(w.rowsBetween(-2, 0)))
    state = F.last(F.expr("CASE WHEN s > 6000 * m THEN 1 WHEN s < 3000 * m THEN 0 END"), ignorenulls=True).over(w.rowsBetween(*_ALL_BEFORE))
    turned = voted.withColumn("state", state).withColumn("before", F.lag("state").over(w)).where("state <> coalesce(before, 0)")
    return turned.select("user_id", "event_id", "us", F.col("state").cast("bigint").alias("state"))


TWO_SQL = f"""WITH {CENTS}, v AS (SELECT *, sum(cents) OVER w AS s, count(*) OVER w AS m FROM k WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, last_value(CASE WHEN s > 6000 * m THEN 1 WHEN s < 3000 * m THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS state FROM v),
b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM t) SELECT user_id, event_id, us, CAST(state AS BIGINT) AS state FROM b WHERE state <> coalesce(before, 0)"""


def central_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed by central differences, one-sided at the ends: value change and time between the neighbours."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    lead, lag = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)), lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    return _cents(spark, sf_dir).select("event_id", (lead("cents") - lag("cents")).alias("dv"), (lead("us") - lag("us")).alias("dt"))


SPEED_SQL = f"""WITH {CENTS} SELECT event_id, coalesce(lead(cents) OVER w, cents) - coalesce(lag(cents) OVER w, cents) AS dv, coalesce(lead(us) OVER w, us) - coalesce(lag(us) OVER w, us) AS dt
FROM k WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)"""


def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People numbered by the day's first appearance, ties by id."""
    first = events(spark, sf_dir).groupBy(F.expr(f"us div {DAY}").alias("day"), "user_id").agg(F.min("us").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("day").orderBy("first", "user_id")).cast("bigint"))


FIRST_SQL = f"WITH {EV}, f AS (SELECT us // {DAY} AS day, user_id, min(us) AS first FROM ev GROUP BY us // {DAY}, user_id) SELECT *, row_number() OVER (PARTITION BY day ORDER BY first, user_id) AS number FROM f"


def flip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: changes of the user's type within 1 and 6 hours on either side."""
    w = Window.partitionBy("user_id").orderBy("us")
    flips = events(spark, sf_dir).withColumn("flip", (F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id")) != F.col("event_type")).cast("int"))
    near = lambda h: F.coalesce(F.sum("flip").over(w.rangeBetween(-h * HOUR, h * HOUR)), F.lit(0))
    return flips.select("event_id", near(1).alias("near"), near(6).alias("far"))


FLIP_SQL = f"""WITH {EV}, f AS (SELECT *, CAST(lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) <> event_type AS INTEGER) AS flip FROM ev)
SELECT event_id, CAST(coalesce(sum(flip) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING), 0) AS BIGINT) AS near,
CAST(coalesce(sum(flip) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING), 0) AS BIGINT) AS far FROM f"""


def place_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors get a value from their neighbours (other types) if those are at most 6 hours apart, weighted by nearness in time; whole cents."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    known = F.expr("CASE WHEN event_type <> 'error' THEN named_struct('t', us, 'c', cents) END")
    near = _cents(spark, sf_dir).withColumn("known", known)
    near = near.withColumn("p", F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q", F.first("known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return near.where(f"event_type = 'error' and q.t - p.t between 1 and {6 * HOUR}").select("event_id", F.expr("(p.c * (q.t - us) + q.c * (us - p.t)) div (q.t - p.t)").alias("cents"))


PLACE_SQL = f"""WITH {CENTS}, n AS (SELECT *, CASE WHEN event_type <> 'error' THEN us END AS kt, CASE WHEN event_type <> 'error' THEN cents END AS kc FROM k),
p AS (SELECT *, last_value(kt IGNORE NULLS) OVER b AS pt, last_value(kc IGNORE NULLS) OVER b AS pc, first_value(kt IGNORE NULLS) OVER a AS qt, first_value(kc IGNORE NULLS) OVER a AS qc FROM n
 WINDOW b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, (pc * (qt - us) + qc * (us - pt)) // (qt - pt) AS cents FROM p WHERE event_type = 'error' AND qt - pt BETWEEN 1 AND {6 * HOUR}"""


# --- queues and overlays ---------------------------------------------------------------------------------------------
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of a language: unanswered first, longest first, then by id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.lit(1).alias("done")), "doc_id", "left")
    order = Window.partitionBy("lang").orderBy(F.coalesce("done", F.lit(0)), F.desc("n_chars"), "doc_id")
    return docs.select("doc_id", "lang", F.row_number().over(order).cast("bigint").alias("place"))


QUEUE_SQL = """SELECT d.doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END, n_chars DESC, d.doc_id) AS place
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) l ON d.doc_id = l.doc_id"""


def windows_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with events that are neither ready (a purchase) nor set aside (an error)."""
    e = events(spark, sf_dir).select(F.expr(f"us div {HOUR}").alias("hour"), "event_type")
    kind = lambda k: e.where(F.col("event_type") == k).select("hour")
    return e.select("hour").subtract(kind("purchase")).subtract(kind("error"))


TODO_SQL = f"WITH {EV} SELECT DISTINCT us // {HOUR} AS hour FROM ev EXCEPT SELECT us // {HOUR} FROM ev WHERE event_type = 'purchase' EXCEPT SELECT us // {HOUR} FROM ev WHERE event_type = 'error'"


def frame_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees: originals with their overrides, without deleted ones, with rows added by hand; and where each came from."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr("CAST(n_chars AS BIGINT)").alias("value"))
    lab = read_table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    view = docs.join(lab, "id", "left").where("coalesce(toxic, 0) <> 1").selectExpr("id", "CASE WHEN quality IS NULL THEN value ELSE CAST(quality AS BIGINT) END AS value", "CASE WHEN quality IS NULL THEN 'original' ELSE 'override' END AS origin")
    return view.union(read_table(spark, sf_dir, "benchmark").selectExpr("-1 - CAST(item_id AS BIGINT)", "CAST(length(text) AS BIGINT)", "'manual'"))


VIEW_SQL = """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT d.doc_id AS id, CASE WHEN quality IS NULL THEN CAST(n_chars AS BIGINT) ELSE CAST(quality AS BIGINT) END AS value, CASE WHEN quality IS NULL THEN 'original' ELSE 'override' END AS origin
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) <> 1 UNION ALL SELECT -1 - CAST(item_id AS BIGINT), CAST(length(text) AS BIGINT), 'manual' FROM benchmark"""


def interval_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts (view, click) and deletes (error) of a user's zones in log order: the zones that stand, with value and number of edits."""
    ops = _cents(spark, sf_dir).where("event_type in ('view', 'click', 'error')").select("user_id", "props", "us", "event_id", "event_type", "cents")
    counts = ops.groupBy("user_id", "props").agg(F.count("*").alias("edits"))
    last = overlay.latest(ops.withColumn("seq", F.struct("us", "event_id")), ["user_id", "props"], "seq")
    return last.join(counts, ["user_id", "props"]).where("event_type <> 'error'").select("user_id", "props", "cents", "edits")


EDITS_SQL = f"""WITH {CENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY us DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, props) AS edits FROM k WHERE event_type IN ('view', 'click', 'error'))
SELECT user_id, props, cents, edits FROM o WHERE r = 1 AND event_type <> 'error'"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimistic writers: a user's k-th event expects revision k div 2; those that expect the current revision stand and raise it."""
    ops = events(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))).selectExpr("user_id", "event_id", "CAST(seq AS BIGINT) AS seq", "CAST(seq div 2 AS BIGINT) AS expected")
    return overlay.accepted(ops, ["user_id"]).select("user_id", "event_id", "revision")


# An operation expects half its number: the k-th accepted one is the first with number 2k.
TRANSACTION_SQL = f"""WITH {EV}, o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM ev)
SELECT user_id, event_id, seq // 2 + 1 AS revision FROM o WHERE seq = 1 OR seq % 2 = 0"""


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised identities: the label given by hand, else the group's (the most frequent label of a source), else the piece itself."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    own = read_table(spark, sf_dir, "labels").where("quality is not null and doc_id % 3 = 0").groupBy("doc_id").agg(F.max("quality").alias("own"))
    labelled = docs.join(own, "doc_id", "left")
    group = labelled.groupBy("source").agg(F.count_if(F.expr("own = 1")).alias("ones"), F.count_if(F.expr("own = 0")).alias("zeros"))
    name = "CASE WHEN own IS NOT NULL THEN concat('own-', own) WHEN ones > zeros THEN 'group-1' WHEN zeros > 0 THEN 'group-0' ELSE concat('piece-', doc_id) END"
    return labelled.join(group, "source", "left").selectExpr("doc_id", f"{name} AS identity")


IDENTITY_SQL = """WITH o AS (SELECT doc_id, max(quality) AS own FROM labels WHERE quality IS NOT NULL AND doc_id % 3 = 0 GROUP BY doc_id), l AS (SELECT d.doc_id, source, own FROM documents d LEFT JOIN o USING (doc_id)),
g AS (SELECT source, count(*) FILTER (own = 1) AS ones, count(*) FILTER (own = 0) AS zeros FROM l GROUP BY source)
SELECT doc_id, CASE WHEN own IS NOT NULL THEN concat('own-', own) WHEN ones > zeros THEN 'group-1' WHEN zeros > 0 THEN 'group-0' ELSE concat('piece-', doc_id) END AS identity FROM l LEFT JOIN g USING (source)"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted proposals never overwrite a human decision: what stands, and whether a proposal was accepted, shadowed or left."""
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN n_chars % 7 = 0 THEN 1 WHEN n_chars % 7 < 4 THEN 0 END AS proposal")
    human = read_table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("human"))
    fate = "CASE WHEN proposal IS NULL THEN 'none' WHEN human IS NULL THEN 'accepted' WHEN human = proposal THEN 'agrees' ELSE 'shadowed' END"
    return docs.join(human, "doc_id", "left").selectExpr("doc_id", "CAST(coalesce(human, proposal) AS BIGINT) AS stands", f"{fate} AS fate")


PROPOSAL_SQL = """WITH h AS (SELECT doc_id, max(quality) AS human FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), d AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 1 WHEN n_chars % 7 < 4 THEN 0 END AS proposal FROM documents)
SELECT doc_id, CAST(coalesce(human, proposal) AS BIGINT) AS stands, CASE WHEN proposal IS NULL THEN 'none' WHEN human IS NULL THEN 'accepted' WHEN human = proposal THEN 'agrees' ELSE 'shadowed' END AS fate FROM d LEFT JOIN h USING (doc_id)"""


def door_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked (kind, person, zone) and visits from the valid ones: per user entries, exits and answers refused, by reason."""
    zone = F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)")
    checked = events(spark, sf_dir).withColumn("zone", zone).selectExpr("user_id", "event_type", "CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'kind' WHEN value < 20 THEN 'person' WHEN zone > 7 THEN 'zone' END AS refused")
    counts = {"entries": "refused IS NULL AND event_type = 'view'", "exits": "refused IS NULL AND event_type = 'purchase'", "bad_kind": "refused = 'kind'", "bad_person": "refused = 'person'", "bad_zone": "refused = 'zone'"}
    return checked.groupBy("user_id").agg(*[F.count_if(F.expr(e)).alias(c) for c, e in counts.items()])


ANSWERS_SQL = f"""WITH {EV}, c AS (SELECT user_id, event_type, CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'kind' WHEN value < 20 THEN 'person' WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) > 7 THEN 'zone' END AS refused FROM ev)
SELECT user_id, count(*) FILTER (refused IS NULL AND event_type = 'view') AS entries, count(*) FILTER (refused IS NULL AND event_type = 'purchase') AS exits, count(*) FILTER (refused = 'kind') AS bad_kind,
count(*) FILTER (refused = 'person') AS bad_person, count(*) FILTER (refused = 'zone') AS bad_zone FROM c GROUP BY user_id"""


def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the signature a cached build is kept under: rows and the sum of their hashes, whatever their order.

    From some 65,000 rows a day on the sum may exceed 64 bits; it then wraps around as a signed 64-bit number.
    """
    row = F.expr("CAST(conv(substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 12), 16, 10) AS DECIMAL(18, 0))")
    sums = events(spark, sf_dir).groupBy(F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.sum(row).alias("s"))
    wrapped = sums.withColumn("s", F.expr(f"s % CAST({2**64} AS DECIMAL(20, 0))"))
    return wrapped.select("day", "n", F.expr(f"CAST(CASE WHEN s >= CAST({2**63} AS DECIMAL(20, 0)) THEN s - CAST({2**64} AS DECIMAL(20, 0)) ELSE s END AS BIGINT)").alias("signature"))


SIGNATURE_SQL = f"""WITH {EV} SELECT us // {DAY} AS day, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 12) AS BIGINT)) AS BIGINT) AS signature FROM ev GROUP BY us // {DAY}"""


def label_allocator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New labels for users without one, from the highest of the day on, in order of first appearance."""
    per = events(spark, sf_dir).groupBy(F.expr(f"us div {DAY}").alias("day"), "user_id").agg(F.min("us").alias("first"), F.max(F.expr("CASE WHEN event_type = 'signup' THEN user_id END")).alias("label"))
    top = F.coalesce(F.max("label").over(Window.partitionBy("day")), F.lit(0))
    new = F.row_number().over(Window.partitionBy("day", F.col("label").isNull()).orderBy("first", "user_id"))
    return per.select("day", "user_id", F.coalesce("label", (top + new).cast("bigint")).alias("label"))


ALLOCATOR_SQL = f"""WITH {EV}, p AS (SELECT us // {DAY} AS day, user_id, min(us) AS first, max(CASE WHEN event_type = 'signup' THEN user_id END) AS label FROM ev GROUP BY us // {DAY}, user_id)
SELECT day, user_id, coalesce(label, coalesce(max(label) OVER (PARTITION BY day), 0) + row_number() OVER (PARTITION BY day, label IS NULL ORDER BY first, user_id)) AS label FROM p"""

# --- protocols -------------------------------------------------------------------------------------------------------
_SCORES = "SELECT l.doc_id, source AS day, quality = 1 AS truth, n_chars % 100 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return lab.join(read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").selectExpr("doc_id", "source AS day", "quality = 1 AS truth", "n_chars % 100 AS score")


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source judged by the threshold that is best on all others: F1 as 2tp / (2tp + fp + fn), from counts per source and threshold."""
    cuts = _scored(spark, sf_dir).select("day", "truth", "score", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(10))).alias("cut"))
    own = cuts.groupBy("day", "cut").agg(F.count_if(F.expr("truth and score >= cut")).alias("tp"), F.count_if(F.expr("not truth and score >= cut")).alias("fp"), F.count_if(F.expr("truth and score < cut")).alias("fn"))
    every = Window.partitionBy("cut")
    rest = own.select("*", *[(F.sum(c).over(every) - F.col(c)).alias(f"o{c}") for c in ("tp", "fp", "fn")])
    order = Window.partitionBy("day").orderBy(F.expr("otp * 2000000 div greatest(2 * otp + ofp + ofn, 1)").desc(), "cut")
    return rest.withColumn("r", F.row_number().over(order)).where("r = 1").select("day", F.col("cut").cast("bigint").alias("cut"), "tp", "fp", "fn")


LEAVE_SQL = f"""WITH s AS ({_SCORES}), c AS (SELECT *, unnest(range(10, 91, 10)) AS cut FROM s),
o AS (SELECT day, cut, count(*) FILTER (truth AND score >= cut) AS tp, count(*) FILTER (NOT truth AND score >= cut) AS fp, count(*) FILTER (truth AND score < cut) AS fn FROM c GROUP BY day, cut),
r AS (SELECT *, sum(tp) OVER w - tp AS otp, sum(fp) OVER w - fp AS ofp, sum(fn) OVER w - fn AS ofn FROM o WINDOW w AS (PARTITION BY cut))
SELECT day, cut, tp, fp, fn FROM r QUALIFY row_number() OVER (PARTITION BY day ORDER BY otp * 2000000 // greatest(2 * otp + ofp + ofn, 1) DESC, cut) = 1"""


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations go to training or validation by a hash; counts, and conversations found in both (none)."""
    part = F.expr("CASE WHEN conv(substr(md5(CAST(conv_id AS STRING)), 1, 4), 16, 10) % 5 = 0 THEN 'val' ELSE 'train' END")
    turns = read_table(spark, sf_dir, "conversations").withColumn("part", part)
    return turns.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("groups"))


GROUPS_SQL = """SELECT CASE WHEN CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 4) AS BIGINT) % 5 = 0 THEN 'val' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT conv_id) AS groups FROM conversations GROUP BY 1"""


def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over two parameters of a rule (shortest text, cut of the score): hits and misses of each, best first by hits less twice the misses."""
    grid = spark.createDataFrame([(a, b) for a in (50, 200, 800) for b in (20, 40, 60, 80)], "shortest bigint, cut bigint")
    lab = _scored(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    hit = "n_chars >= shortest AND score >= cut"
    tried = lab.crossJoin(F.broadcast(grid)).groupBy("shortest", "cut").agg(F.count_if(F.expr(f"{hit} AND truth")).alias("hits"), F.count_if(F.expr(f"{hit} AND NOT truth")).alias("misses"))  # bounded: twelve rules
    return tried.withColumn("place", F.row_number().over(Window.orderBy(F.expr("hits - 2 * misses").desc(), "shortest", "cut")).cast("bigint"))


GRID_SQL = f"""WITH s AS ({_SCORES}), g AS (SELECT a AS shortest, b AS cut FROM (VALUES (50), (200), (800)) x(a), (VALUES (20), (40), (60), (80)) y(b)), l AS (SELECT s.*, n_chars FROM s JOIN documents USING (doc_id)),
t AS (SELECT CAST(shortest AS BIGINT) AS shortest, CAST(cut AS BIGINT) AS cut, count(*) FILTER (n_chars >= shortest AND score >= cut AND truth) AS hits, count(*) FILTER (n_chars >= shortest AND score >= cut AND NOT truth) AS misses FROM l, g GROUP BY shortest, cut)
SELECT *, row_number() OVER (ORDER BY hits - 2 * misses DESC, shortest, cut) AS place FROM t"""


def active_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to label next in each source: scores in the unsure band, most disagreement between two seeds first, ten each."""
    seed = lambda k: F.expr(f"CAST(conv(substr(md5(concat(doc_id, '-{k}')), 1, 4), 16, 10) AS BIGINT) % 100")
    unsure = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("n_chars % 100").alias("score"), F.abs(seed(1) - seed(2)).alias("gap")).where("score between 35 and 65")
    return unsure.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("gap"), "doc_id"))).where("r <= 10").select("doc_id", "source", "gap")


ACTIVE_SQL = """WITH u AS (SELECT doc_id, source, abs(CAST('0x' || substr(md5(concat(doc_id, '-1')), 1, 4) AS BIGINT) % 100 - CAST('0x' || substr(md5(concat(doc_id, '-2')), 1, 4) AS BIGINT) % 100) AS gap FROM documents WHERE n_chars % 100 BETWEEN 35 AND 65)
SELECT doc_id, source, gap FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap DESC, doc_id) <= 10"""


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's active hours spread evenly: the hours in six equal runs, the busiest hour of each."""
    hours = events(spark, sf_dir).groupBy("user_id", F.expr(f"us div {HOUR}").alias("hour")).agg(F.count("*").alias("n"))
    runs = hours.withColumn("run", F.ntile(6).over(Window.partitionBy("user_id").orderBy("hour")))
    return runs.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "run").orderBy(F.desc("n"), "hour"))).where("r = 1").selectExpr("user_id", "CAST(run AS BIGINT) AS run", "hour", "n")


QUOTA_SQL = f"""WITH {EV}, h AS (SELECT user_id, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY user_id, us // {HOUR}), r AS (SELECT *, ntile(6) OVER (PARTITION BY user_id ORDER BY hour) AS run FROM h)
SELECT user_id, run, hour, n FROM r QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY n DESC, hour) = 1"""


def blind_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blind comparison undone: each item's sides were swapped by a hash; votes (even length: left) counted for the true sides."""
    swapped = "CAST(conv(substr(md5(CAST(doc_id AS STRING)), 1, 2), 16, 10) AS BIGINT) % 2 = 1"
    votes = read_table(spark, sf_dir, "documents").selectExpr("lang", f"{swapped} AS swapped", "n_chars % 2 = 0 AS took_left")
    return votes.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("swapped").alias("swapped"), F.count_if(F.expr("took_left <> swapped")).alias("first"))


BLIND_SQL = """WITH v AS (SELECT lang, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) % 2 = 1 AS swapped, n_chars % 2 = 0 AS took_left FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (swapped) AS swapped, count(*) FILTER (took_left <> swapped) AS first FROM v GROUP BY lang"""


def lease_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three jobs of each priority: open ones first, then claims silent the longest; delivered ones are out."""
    jobs = read_table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority", F.expr("CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END").alias("claimed"), "o_orderdate")
    order = Window.partitionBy("o_orderpriority").orderBy("claimed", "o_orderdate", "o_orderkey")
    return jobs.withColumn("place", F.row_number().over(order)).where("place <= 3").selectExpr("o_orderkey", "o_orderpriority", "CAST(place AS BIGINT) AS place")


LEASE_SQL = """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F' QUALIFY place <= 3"""


def failure_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries of a user (purchase: done, error: failed): what may be tried again: not done since, and 12 hours past the last failure at the log's end."""
    book = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.expr("CASE WHEN event_type = 'error' THEN us END")).alias("failed"), F.max(F.expr("CASE WHEN event_type = 'purchase' THEN us END")).alias("done"), F.count_if(F.expr("event_type = 'error'")).alias("failures"))
    end = events(spark, sf_dir).agg(F.max("us").alias("now"))
    return book.crossJoin(F.broadcast(end)).where(f"failed is not null and failed > coalesce(done, 0) and now - failed >= {12 * HOUR}").select("user_id", "failures", "failed")  # one row


FAILURE_SQL = f"""WITH {EV}, b AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN us END) AS failed, max(CASE WHEN event_type = 'purchase' THEN us END) AS done, count(*) FILTER (event_type = 'error') AS failures FROM ev GROUP BY user_id)
SELECT user_id, failures, failed FROM b WHERE failed > coalesce(done, 0) AND (SELECT max(us) FROM ev) - failed >= {12 * HOUR}"""

QUERIES = {
    "cannot_links": (cannot_links, CANNOT_SQL), "neighbour_visits": (neighbour_visits, NEIGHBOUR_SQL), "seam_pairs": (seam_pairs, SEAM_SQL), "break_candidates": (break_candidates, BREAK_SQL), "sidecars": (sidecars, SIDECAR_SQL),
    "single_pairs": (single_pairs, SINGLE_SQL), "membership_bridges": (membership_bridges, BRIDGE_SQL), "answer_pairs": (answer_pairs, ANSWER_SQL), "stitch_score": (stitch_score, STITCH_SQL), "tracker_gates": (tracker_gates, GATES_SQL),
    "robust_scalars": (robust_scalars, ROBUST_SQL), "person_merge": (person_merge, MERGE_SQL), "candidate_clusters": (candidate_clusters, CLUSTER_SQL), "regression_summary": (regression_summary, REGRESSION_SQL),
    "zero_false_positive": (zero_false_positive, ZERO_SQL), "model_fits": (model_fits, FITS_SQL), "span_activity": (span_activity, ACTIVITY_SQL), "distinct_counts": (distinct_counts, DISTINCT_SQL), "change_points": (change_points, CHANGE_SQL),
    "best_splits": (best_splits, SPLIT_SQL), "two_thresholds": (two_thresholds, TWO_SQL), "central_speeds": (central_speeds, SPEED_SQL), "first_appearance": (first_appearance, FIRST_SQL), "flip_counts": (flip_counts, FLIP_SQL),
    "place_interpolation": (place_interpolation, PLACE_SQL), "queue_order": (queue_order, QUEUE_SQL), "windows_to_do": (windows_to_do, TODO_SQL), "frame_view": (frame_view, VIEW_SQL), "interval_edits": (interval_edits, EDITS_SQL),
    "transactions": (transactions, TRANSACTION_SQL), "identities": (identities, IDENTITY_SQL), "proposals": (proposals, PROPOSAL_SQL), "door_answers": (door_answers, ANSWERS_SQL), "content_signatures": (content_signatures, SIGNATURE_SQL),
    "label_allocator": (label_allocator, ALLOCATOR_SQL), "leave_one_out": (leave_one_out, LEAVE_SQL), "group_split": (group_split, GROUPS_SQL), "rule_grid": (rule_grid, GRID_SQL), "active_selection": (active_selection, ACTIVE_SQL),
    "quota_sample": (quota_sample, QUOTA_SQL), "blind_tally": (blind_tally, BLIND_SQL), "lease_queue": (lease_queue, LEASE_SQL), "failure_book": (failure_book, FAILURE_SQL),
}
