"""A day's visits as one result: fragments, their neighbours, human answers, merges with vetoes, visits, proposals.

The event log stands in for a shop's recordings: a shop is 50 users, a clip is 8 hours, a second grid of clips lies half a clip
later, and a fragment is what one clip holds of a user. So the fragments of the two grids share raw observations. A fragment
of two events or more is reviewed, its label is its user. A signup is a human answer about its fragment and the fragment of the
shop's event before it, pinned to the number of events both had an hour after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grids, merging
from ..operators.intervals import bucketed_overlap_join, sessions
from ..operators.scratch import cut
from ..sources import events
from .event_sequences import DAY, EV, HOUR, MINUTE
from .reviews import _SESSIONS

CLIP, NEAR, CAP, SHOP = 8 * HOUR, 20 * MINUTE, 3, 50
ORDER = ["stage", "us", "eid"]


def _clip(us: str, grid: str) -> str:
    return f"(2 * floor(({us} + {grid} * {CLIP // 2}) / {CLIP}) + {grid})"


def _key(us: str, grid: str) -> str:
    return f"CAST({_clip(us, grid)} * 10000000 + user_id AS BIGINT)"


def _day(clip: str, grid: str) -> str:
    return f"CAST(floor((({clip} - {grid}) / 2 * {CLIP} - {grid} * {CLIP // 2}) / {DAY}) AS BIGINT)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, shop, day, clip, user_id, first, last, n, cents); a fragment belongs to the day its clip begins on."""
    at = F.expr(f"CAST({_clip('us', 'grid')} AS BIGINT)")
    log = events(spark, sf_dir).select("event_id", "user_id", "us", F.expr("CAST(round(value * 100) AS BIGINT)").alias("cents"), F.explode(F.array(F.lit(0), F.lit(1))).alias("grid"))
    out = log.groupBy(F.expr(_key("us", "grid")).alias("node"), at.alias("clip"), "grid", "user_id").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return out.select("node", F.expr(f"user_id div {SHOP}").alias("shop"), F.expr(_day("clip", "grid")).alias("day"), "clip", "user_id", "first", "last", "n", "cents")


def answers(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """(a, b, decision, us, eid, valid): the last answer of every pair of a day's fragments; valid while both are as they were."""
    log = events(spark, sf_dir).withColumn("shop", F.expr(f"user_id div {SHOP}")).withColumn("clip", F.expr(f"CAST({_clip('us', '0')} AS BIGINT)")).withColumn("node", F.expr(_key("us", "0")))
    w = Window.partitionBy("shop", "clip").orderBy("us", "event_id")
    asked = log.withColumn("other", F.lag("node").over(w)).where("event_type = 'signup' and other <> node")
    last = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("us"), F.desc("event_id")))
    asked = asked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "us", "event_id", F.expr("element_at(array('same', 'different', 'unsure'), CAST(round(value * 100) AS INT) % 3 + 1)").alias("decision"))
    asked = asked.withColumn("_k", last).where("_k = 1")
    for side in ("a", "b"):
        asked = asked.join(nodes.select(F.col("node").alias(side), F.col("day").alias(f"day_{side}"), F.col("last").alias(f"last_{side}")), side)
    return asked.where("day_a = day_b").select("a", "b", "decision", "us", F.col("event_id").alias("eid"), F.expr(f"greatest(last_a, last_b) <= us + {HOUR}").alias("valid"))


def day_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fragments; their groups (node, root); the fates of links (a, b, stage, fate); valid answers (a, b, decision, us, eid)."""
    nodes = cut(fragments(spark, sf_dir), "day-nodes")
    valid = cut(answers(spark, sf_dir, nodes).where("valid").drop("valid"), "day-answers")
    # An observation is in two fragments at most, one of each grid. Fragments that share one are near each other, so only their days may keep them apart.
    log = events(spark, sf_dir).select(*[F.expr(e).alias(n) for grid in "01" for e, n in ((_key("us", grid), f"f{grid}"), (_day(f"CAST({_clip('us', grid)} AS BIGINT)", grid), f"d{grid}"))]).where("d0 = d1")
    shared = log.groupBy(F.least("f0", "f1").alias("a"), F.greatest("f0", "f1").alias("b")).agg(F.count("*").alias("frames")).where("frames >= 2 and a <> b")
    auto = shared.join(valid, ["a", "b"], "left_anti").select("a", "b", F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("eid"))
    human = valid.where("decision = 'same'").select("a", "b", F.lit(0).alias("stage"), "us", "eid")
    links = cut(human.unionByName(auto), "day-links")
    labels = nodes.where("n >= 2").select("node", F.col("clip").alias("scope"), F.col("user_id").alias("label"))
    tags = merging.veto_tags(labels, valid.where("decision = 'different'").select("a", "b"))
    groups, fates = merging.merge_with_vetoes(links, tags, ORDER)
    fates = cut(fates.join(links.select("a", "b", "stage"), ["a", "b"]), "day-fates")
    groups = cut(nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "day-groups")
    return nodes, groups, fates, valid


def day_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits of every shop and day: first fragment, number of fragments, first and last moment."""
    nodes, groups, _, _ = day_graph(spark, sf_dir)
    return nodes.join(groups, "node").groupBy("shop", "day", "root").agg(F.count("*").alias("n_nodes"), F.min("first").alias("first"), F.max("last").alias("last")).withColumnRenamed("root", "visit")


def day_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and what became of each: merged, inside a visit already, or vetoed by labels or a human "different"."""
    return day_graph(spark, sf_dir)[2].select("a", "b", F.when(F.col("stage") == 0, "human").otherwise("shared_frames").alias("source"), "fate")


def day_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to ask about: of different visits, closest first, at most three for each fragment.

    What decides on a pair is brought to the fragments before they are paired: their visits and, few each, whom answers name.
    Links that weren't vetoed lie inside visits.
    """
    nodes, groups, _, valid = day_graph(spark, sf_dir)
    told = valid.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("told"))
    span = nodes.join(groups, "node").join(told, "node", "left").withColumn("stop", F.col("last") + NEAR)
    other = span.select("shop", "day", *[F.col(c).alias(f"{c}2") for c in ("node", "clip", "first", "stop", "last", "n", "cents", "root")])
    near = bucketed_overlap_join(span, other, ["shop", "day"], ("first", "stop"), ("first2", "stop2"), HOUR)
    near = near.where("node < node2 and clip <> clip2 and root <> root2 and not coalesce(array_contains(told, node2), false)")
    gap = F.greatest(F.lit(0), F.greatest("first", "first2") - F.least("last", "last2"))
    apart = F.expr("abs(cents * n2 - cents2 * n) * 1000 div (n * n2)")
    open_ = near.select("shop", "day", F.col("node").alias("a"), F.col("node2").alias("b"), apart.alias("distance"), gap.alias("gap"))
    return merging.capped_pairs(open_, ["distance", "gap"], CAP, ["shop", "day"])


PRICES, LIMITS, APART = [0, 20, 80], [400, 1_000, 2_500], 40 * MINUTE


def stitch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joining a shop's sessions of a day would give for each price of a minute's gap and each limit: people whole, groups mixed.

    Two sessions may be one person's if one ends up to 40 minutes before the other; their looks differ by their mean values in
    cents. Sessions at the same time are different people.
    """
    spans = sessions(events(spark, sf_dir).withColumn("cents", F.expr("CAST(round(value * 100) AS BIGINT)")), ["user_id"], "us", 30 * MINUTE, F.min("event_id").alias("node"), F.sum("cents").alias("cents"))
    spans = cut(spans.select("node", "user_id", F.expr(f"user_id div {SHOP}").alias("shop"), F.expr(f"start div {DAY}").alias("day"), "start", "end", "n", "cents"), "grid-spans")
    late = spans.withColumn("stop", F.col("end") + APART)
    other = spans.select("shop", "day", *[F.col(c).alias(f"{c}2") for c in ("node", "start", "end", "n", "cents")])
    near = bucketed_overlap_join(late, other, ["shop", "day"], ("start", "stop"), ("start2", "end2"), HOUR).where("node <> node2")
    ahead = near.where("start2 > end").select("shop", "day", F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), F.expr("abs(cents * n2 - cents2 * n) div (n * n2)").alias("look"), F.expr(f"(start2 - end) div {MINUTE}").alias("gap"))
    both = near.where("node < node2 and start2 <= end and start <= end2").select("shop", "day", F.col("node").alias("a"), F.col("node2").alias("b"))
    return grids.grid_scores(grids.merge_grid(ahead, both, PRICES, LIMITS, ["shop", "day"]), spans.select("node", F.col("user_id").alias("person"))).select("price", "limit", "people", "whole", "n_groups", "mixed")


_CLIP = lambda us, grid: f"(2 * floor(({us} + {grid} * {CLIP // 2}) / {CLIP}) + {grid})::BIGINT"
_TABLES = f"""{EV}, k AS (SELECT *, user_id // {SHOP} AS shop, CAST(round(value * 100) AS BIGINT) AS cents FROM ev),
g AS (SELECT *, {_CLIP('us', 'grid')} AS clip FROM k, range(2) t(grid)), h AS (SELECT *, clip * 10000000 + user_id AS node FROM g),
nodes AS (SELECT node, shop, floor(((clip - grid) / 2 * {CLIP} - grid * {CLIP // 2}) / {DAY})::BIGINT AS day, clip, user_id, min(us) AS first, max(us) AS last, count(*) AS n, sum(cents)::BIGINT AS cents FROM h GROUP BY node, shop, clip, grid, user_id),
z AS (SELECT * FROM h WHERE grid = 0), asked AS (SELECT *, lag(node) OVER (PARTITION BY shop, clip ORDER BY us, event_id) AS other FROM z),
said0 AS (SELECT least(node, other) AS a, greatest(node, other) AS b, ['same', 'different', 'unsure'][cents % 3 + 1] AS decision, us, event_id FROM asked WHERE event_type = 'signup' AND other <> node),
said AS (SELECT * FROM said0 s WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.node IN (s.a, s.b) AND z.us > s.us + {HOUR}) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY us DESC, event_id DESC) = 1),
last AS (SELECT a, b, max((us, event_id)) AS m FROM said0 GROUP BY a, b), valid AS (SELECT s.* FROM said s JOIN last l ON s.a = l.a AND s.b = l.b AND (s.us, s.event_id) = l.m JOIN nodes x ON x.node = s.a JOIN nodes y ON y.node = s.b WHERE x.day = y.day),
near AS (SELECT x.shop, x.day, x.node AS a, y.node AS b, abs(x.cents * y.n - y.cents * x.n) * 1000 // (x.n * y.n) AS distance, greatest(0, greatest(x.first, y.first) - least(x.last, y.last)) AS gap
  FROM nodes x JOIN nodes y ON x.shop = y.shop AND x.day = y.day AND x.node < y.node AND x.clip <> y.clip AND x.first <= y.last + {NEAR} AND y.first <= x.last + {NEAR} WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.a = x.node AND v.b = y.node)),
shared AS (SELECT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM h x JOIN h y ON x.event_id = y.event_id AND x.grid = 0 AND y.grid = 1 GROUP BY 1, 2 HAVING count(*) >= 2),
links AS (SELECT n.shop, n.day, a, b, 0 AS stage, us, event_id FROM valid JOIN nodes n ON n.node = a WHERE decision = 'same' UNION ALL SELECT shop, day, a, b, 1, 0, 0 FROM near JOIN shared USING (a, b)),
steps AS (SELECT *, row_number() OVER (PARTITION BY shop, day ORDER BY stage, us, event_id, a, b) AS k FROM links),
tagged AS (SELECT shop, day, list({{'n': node, 't': clip::VARCHAR, 'v': user_id}}) AS tags FROM (
  SELECT shop, day, node, 'l' || clip AS clip, user_id FROM nodes WHERE n >= 2 UNION ALL SELECT n.shop, n.day, n.node, 'd' || v.a || '|' || v.b, n.node FROM valid v JOIN nodes n ON n.node IN (v.a, v.b) WHERE decision = 'different') GROUP BY shop, day),
roots AS (SELECT shop, day, map(list(node), list(node)) AS root FROM (SELECT shop, day, a AS node FROM links UNION SELECT shop, day, b FROM links) GROUP BY shop, day),
fold AS (  -- one link a step and (shop, day): root of every node so far, fate of the step's link
  SELECT shop, day, 0::BIGINT AS k, root, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::INT AS stage, NULL::VARCHAR AS fate FROM roots
  UNION ALL SELECT q.shop, q.day, q.k, CASE WHEN q.fate = 'merged' THEN map_from_entries(list_transform(map_entries(q.root), lambda e: {{'key': e.key, 'value': CASE WHEN e.value = q.hi THEN q.lo ELSE e.value END}})) ELSE q.root END, q.a, q.b, q.stage, q.fate
  FROM (SELECT p.*, CASE WHEN lo = hi THEN 'inside' WHEN len(list_distinct(list_transform(met, lambda m: m.t))) < len(list_distinct(list_transform(met, lambda m: m.t || '=' || m.v))) THEN 'vetoed' ELSE 'merged' END AS fate
    FROM (SELECT o.*, list_filter(coalesce(t.tags, []), lambda m: o.root[m.n] IN (o.lo, o.hi)) AS met FROM (SELECT s.shop, s.day, s.k, f.root, s.a, s.b, s.stage, least(f.root[s.a], f.root[s.b]) AS lo, greatest(f.root[s.a], f.root[s.b]) AS hi
      FROM fold f JOIN steps s ON s.shop = f.shop AND s.day = f.day AND s.k = f.k + 1) o LEFT JOIN tagged t ON t.shop = o.shop AND t.day = o.day) p) q),
ends AS (SELECT shop, day, max_by(root, k) AS root FROM fold GROUP BY shop, day),
grouped AS (SELECT n.*, coalesce(e.root[n.node], n.node) AS visit FROM nodes n LEFT JOIN ends e ON e.shop = n.shop AND e.day = n.day)"""
VISITS_SQL = f"WITH RECURSIVE {_TABLES} SELECT shop, day, visit, count(*) AS n_nodes, min(first) AS first, max(last) AS last FROM grouped GROUP BY shop, day, visit"
LINKS_SQL = f"WITH RECURSIVE {_TABLES} SELECT a, b, CASE WHEN stage = 0 THEN 'human' ELSE 'shared_frames' END AS source, fate FROM fold WHERE k > 0"
_OK = f"(len(list_filter(t.used, lambda u: u = s.a)) < {CAP} AND len(list_filter(t.used, lambda u: u = s.b)) < {CAP})"
PROPOSALS_SQL = f"""WITH RECURSIVE {_TABLES},
asks AS (SELECT n.shop, n.day, n.a, n.b, n.distance, n.gap, row_number() OVER (PARTITION BY n.shop, n.day ORDER BY n.distance, n.gap, n.a, n.b) AS k FROM near n JOIN grouped x ON x.node = n.a JOIN grouped y ON y.node = n.b WHERE x.visit <> y.visit),
taken AS (  -- one pair a step: the ends of the pairs taken so far
  SELECT DISTINCT shop, day, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS distance, NULL::BIGINT AS gap, false AS ok FROM asks
  UNION ALL SELECT s.shop, s.day, s.k, CASE WHEN {_OK} THEN list_concat(t.used, [s.a, s.b]) ELSE t.used END, s.a, s.b, s.distance, s.gap, {_OK} FROM taken t JOIN asks s ON s.shop = t.shop AND s.day = t.day AND s.k = t.k + 1)
SELECT a, b, distance, gap FROM taken WHERE ok"""

GRID_SQL = f"""WITH RECURSIVE {_SESSIONS.replace("ev AS (SELECT event_id", "ev AS (SELECT CAST(round(value * 100) AS BIGINT) AS cents, event_id", 1)},
s AS (SELECT min(event_id) AS node, user_id, user_id // {SHOP} AS shop, min(us) // {DAY} AS day, min(us) AS start, max(us) AS stop, count(*) AS n, sum(cents)::BIGINT AS cents FROM i GROUP BY user_id, island),
c AS (SELECT x.shop, x.day, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b, abs(x.cents * y.n - y.cents * x.n) // (x.n * y.n) AS look, (y.start - x.stop) // {MINUTE} AS gap FROM s x JOIN s y ON x.shop = y.shop AND x.day = y.day AND y.start > x.stop AND y.start <= x.stop + {APART}),
d AS (SELECT x.shop, x.day, list([x.node, y.node]) AS apart FROM s x JOIN s y ON x.shop = y.shop AND x.day = y.day AND x.node < y.node AND y.start <= x.stop AND x.start <= y.stop GROUP BY x.shop, x.day),
e AS (SELECT *, look + price * gap AS cost FROM c, (SELECT unnest({PRICES}) AS price)),
steps AS (SELECT *, row_number() OVER (PARTITION BY shop, day, price ORDER BY cost, a, b) AS k FROM e WHERE cost <= {max(LIMITS)}),
nodes AS (SELECT shop, day, a AS node FROM c UNION SELECT shop, day, b FROM c),
fold AS (SELECT shop, day, price, 0::BIGINT AS k, map(list(node), list(node)) AS root, -1::BIGINT AS cost FROM nodes, (SELECT unnest({PRICES}) AS price) GROUP BY shop, day, price
  UNION ALL SELECT o.shop, o.day, o.price, o.k, CASE WHEN o.lo <> o.hi AND len(list_filter(coalesce(d.apart, []), lambda m: o.root[m[1]] IN (o.lo, o.hi) AND o.root[m[2]] IN (o.lo, o.hi))) = 0
    THEN map_from_entries(list_transform(map_entries(o.root), lambda m: {{'key': m.key, 'value': CASE WHEN m.value = o.hi THEN o.lo ELSE m.value END}})) ELSE o.root END, o.cost
  FROM (SELECT s.shop, s.day, s.price, s.k, f.root, s.cost, least(f.root[s.a], f.root[s.b]) AS lo, greatest(f.root[s.a], f.root[s.b]) AS hi FROM fold f JOIN steps s ON s.shop = f.shop AND s.day = f.day AND s.price = f.price AND s.k = f.k + 1) o
  LEFT JOIN d ON d.shop = o.shop AND d.day = o.day),
ends AS (SELECT shop, day, price, lim, max_by(root, k) AS root FROM fold, (SELECT unnest({LIMITS}) AS lim) WHERE cost <= lim GROUP BY shop, day, price, lim),
groups_ AS (SELECT n.node, e.price, e.lim, e.root[n.node] AS root, s.user_id FROM nodes n JOIN ends e ON e.shop = n.shop AND e.day = n.day JOIN s ON s.node = n.node),
w AS (SELECT price, lim, user_id, count(DISTINCT root) AS n FROM groups_ GROUP BY ALL), m AS (SELECT price, lim, root, min(user_id) <> max(user_id) AS mixed FROM groups_ GROUP BY ALL)
SELECT price, lim AS "limit", (SELECT count(*) FROM w WHERE w.price = x.price AND w.lim = x.lim) AS people, (SELECT count(*) FROM w WHERE w.price = x.price AND w.lim = x.lim AND n = 1) AS whole, count(*) AS n_groups, count(*) FILTER (mixed) AS mixed FROM m x GROUP BY price, lim"""

QUERIES = {"stitch_grid": (stitch_grid, GRID_SQL), "day_visits": (day_visits, VISITS_SQL), "day_links": (day_links, LINKS_SQL), "day_proposals": (day_proposals, PROPOSALS_SQL)}
