"""Identity scoring, embeddings, thresholds, overlays, sampling and queues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, greedy, scratch, tracking, vectors
from ..sources import events, read_table
from .event_sequences import DAY, EV, HOUR, MINUTE

#: Prototypes (three for each label) up to which they are broadcast to the vectors; beyond, every part of the vectors is joined with all of them.
BROADCAST_PROTOTYPES = 30_000
PARTS = 256


def _prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors in id order, dealt into three nearly equal runs; the normalised mean of each run."""
    third = F.ntile(3).over(Window.partitionBy("label").orderBy("vec_id"))
    vecs = read_table(spark, sf_dir, "embeddings").select("label", third.alias("third"), vectors.unit(F.col("embedding")).alias("v"))
    return vectors.mean_vectors(vecs, ["label", "third"], "v").withColumn("v", vectors.unit(F.col("v")))


def _label_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, own, label, d): the distance of every vector to its nearest prototype of every label, in 1e-6."""
    protos = scratch.cut(_prototypes(spark, sf_dir).select(F.col("label"), F.col("v").alias("p")), "prototypes")
    small = protos.count() <= BROADCAST_PROTOTYPES
    vecs = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("own"), vectors.unit(F.col("embedding")).alias("v"))
    if small:
        pairs = vecs.crossJoin(F.broadcast(protos))
    else:
        pairs = vecs.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).join(protos.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "part")
    met = pairs.select("vec_id", "own", "label", F.floor(vectors.cosine_distance(F.col("v"), F.col("p")) * 1e6 + 0.5).alias("d"))
    return met.groupBy("vec_id", "own", "label").agg(F.min("d").alias("d"))


PROTO_CTE = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, ntile(3) OVER (PARTITION BY label ORDER BY vec_id) AS third FROM e),
x AS (SELECT label, third, k, avg(y) AS y FROM (SELECT label, third, unnest(range(1, len(v) + 1)) AS k, unnest(v) AS y FROM u) GROUP BY ALL),
m AS (SELECT label, third, list(y ORDER BY k) AS m FROM x GROUP BY ALL), p AS (SELECT label, third, list_transform(m, lambda z: z / sqrt(list_dot_product(m, m))) AS p FROM m),
ld AS (SELECT u.vec_id, u.label AS own, p.label, min(CAST(floor((1 - list_dot_product(u.v, p.p)) * 1e6 + 0.5) AS BIGINT)) AS d FROM u, p GROUP BY ALL)"""


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each prototype's run, and the distance of its label's vectors: nearest own and nearest other prototype."""
    d = _label_distances(spark, sf_dir)
    return d.groupBy("own").agg(F.min(F.when(F.col("own") == F.col("label"), F.col("d"))).alias("nearest_own"), F.max(F.when(F.col("own") == F.col("label"), F.col("d"))).alias("farthest_own"), F.min(F.when(F.col("own") != F.col("label"), F.col("d"))).alias("nearest_other"))


PROTOTYPES_SQL = f"WITH {PROTO_CTE} SELECT own, min(d) FILTER (own = label) AS nearest_own, max(d) FILTER (own = label) AS farthest_own, min(d) FILTER (own <> label) AS nearest_other FROM ld GROUP BY own"


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three labels nearest to each vector."""
    w = Window.partitionBy("vec_id").orderBy("d", "label")
    return _label_distances(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vec_id", "rank", "label", "d")


TOPK_SQL = f"WITH {PROTO_CTE}, r AS (SELECT vec_id, label, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS rank FROM ld) SELECT vec_id, rank, label, d FROM r WHERE rank <= 3"


def fpr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors and their nearest prototype of each label: the distance that 2 % stay under with other labels, and the share it keeps with their own.

    A vector is part of its own label's prototype; ``pair_calibration`` has the pairs of vectors themselves.
    """
    d = _label_distances(spark, sf_dir).withColumn("same", F.col("own") == F.col("label"))
    gate = d.where("not same").agg(F.percentile(F.col("d").cast("double"), 0.02).alias("gate"))
    return d.join(F.broadcast(gate)).groupBy("gate").agg(
        F.count_if(F.col("same") & (F.col("d") <= F.col("gate"))).alias("kept_same"), F.count_if("same").alias("same"), F.count_if(~F.col("same") & (F.col("d") <= F.col("gate"))).alias("kept_different"),
        F.percentile(F.when(F.col("same"), F.col("d").cast("double")), 0.5).alias("median_same"), F.percentile(F.when(~F.col("same"), F.col("d").cast("double")), 0.5).alias("median_different"),
    )


GATE_SQL = f"""WITH {PROTO_CTE}, g AS (SELECT quantile_cont(CAST(d AS DOUBLE), 0.02) AS gate FROM ld WHERE own <> label)
SELECT gate, count(*) FILTER (own = label AND d <= gate) AS kept_same, count(*) FILTER (own = label) AS same, count(*) FILTER (own <> label AND d <= gate) AS kept_different,
quantile_cont(CAST(d AS DOUBLE), 0.5) FILTER (own = label) AS median_same, quantile_cont(CAST(d AS DOUBLE), 0.5) FILTER (own <> label) AS median_different FROM ld, g GROUP BY gate"""


def pair_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a vector is nearer to its own label's prototypes than a vector to another label's, ties counted half; from counts of each distance, so no global sort of rows."""
    hist = _label_distances(spark, sf_dir).groupBy("d").agg(F.count_if(F.col("own") == F.col("label")).alias("s"), F.count_if(F.col("own") != F.col("label")).alias("o"))
    later = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    won = hist.withColumn("beyond", F.coalesce(F.sum("o").over(later), F.lit(0)))
    return won.agg((F.sum(F.col("s") * (2 * F.col("beyond") + F.col("o"))) / (2 * F.sum("s") * F.sum("o"))).alias("auc"), F.sum("s").alias("same"), F.sum("o").alias("different"))


AUC_SQL = f"""WITH {PROTO_CTE}, h AS (SELECT d, count(*) FILTER (own = label) AS s, count(*) FILTER (own <> label) AS o FROM ld GROUP BY d), w AS (SELECT *, coalesce(sum(o) OVER (ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beyond FROM h)
SELECT CAST(sum(s * (2 * beyond + o)) AS DOUBLE) / CAST(2 * sum(s) * sum(o) AS DOUBLE) AS auc, CAST(sum(s) AS BIGINT) AS same, CAST(sum(o) AS BIGINT) AS different FROM w"""


def _contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth, found, n): labels against the label of the nearest prototype."""
    w = Window.partitionBy("vec_id").orderBy("d", "label")
    return _label_distances(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").groupBy(F.col("own").alias("truth"), F.col("label").alias("found")).agg(F.count("*").alias("n"))


def purity_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per true identity: detections, share of its main id, ids; and whether a minority above 5 % makes that id wrong."""
    c = _contingency(spark, sf_dir)
    per_id = c.groupBy("found").agg(F.sum("n").alias("all"), F.max("n").alias("top"))
    wrong = per_id.select("found", (20 * (F.col("all") - F.col("top")) > F.col("all")).alias("wrong"))
    main = c.groupBy("truth").agg(F.sum("n").alias("detections"), F.count("*").alias("ids"), F.max(F.struct("n", (-F.col("found")).alias("f"))).alias("m"))
    main = main.select("truth", "detections", "ids", F.col("m.n").alias("main"), (-F.col("m.f")).alias("found"))
    return main.join(wrong, "found", "left").select("truth", "detections", "ids", "main", "found", (F.col("main") / F.col("detections")).alias("main_share"), "wrong")


PURITY_SQL = f"""WITH {PROTO_CTE}, b AS (SELECT own, label, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM ld), c AS (SELECT own AS truth, label AS found, count(*) AS n FROM b WHERE r = 1 GROUP BY ALL),
i AS (SELECT found, 20 * (sum(n) - max(n)) > sum(n) AS wrong FROM c GROUP BY found), t AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, found) AS r, sum(n) OVER (PARTITION BY truth) AS detections, count(*) OVER (PARTITION BY truth) AS ids FROM c)
SELECT truth, CAST(detections AS BIGINT) AS detections, ids, n AS main, found, n / detections AS main_share, wrong FROM t JOIN i USING (found) WHERE r = 1"""


def mutual_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and labels of the other parity that are each other's nearest, with the margin to the runner-up."""
    d = _label_distances(spark, sf_dir).where("(own + label) % 2 = 1")
    by_vec, by_label = Window.partitionBy("vec_id").orderBy("d", "label"), Window.partitionBy("label").orderBy("d", "vec_id")
    ranked = d.withColumn("rv", F.row_number().over(by_vec)).withColumn("margin", F.lead("d").over(by_vec) - F.col("d")).withColumn("rl", F.row_number().over(by_label))
    return ranked.where("rv = 1 and rl = 1").select("vec_id", "label", "d", "margin")


MUTUAL_SQL = f"""WITH {PROTO_CTE}, r AS (SELECT vec_id, label, d, row_number() OVER v AS rv, lead(d) OVER v - d AS margin, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rl FROM ld WHERE (own + label) % 2 = 1 WINDOW v AS (PARTITION BY vec_id ORDER BY d, label))
SELECT vec_id, label, d, margin FROM r WHERE rv = 1 AND rl = 1"""


def idf1_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF1 with the best one-to-one mapping of found to true identities; the contingency table is the only input of the assignment."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        table = f.pivot_table(index="truth", columns="found", values="n", fill_value=0).to_numpy()
        hit = int(sum(table[i, j] for i, j in greedy.assignment(-table)))
        return pd.DataFrame({"matched": [hit], "truth": [int(table.sum())], "found": [int(table.sum())], "idf1": [2 * hit / (2 * table.sum())]})

    return _contingency(spark, sf_dir).groupBy(F.lit(1).alias("all")).applyInPandas(run, "matched bigint, truth bigint, found bigint, idf1 double")  # labels squared at most


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of "at least so many characters" against the quality label, at nine cuts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = read_table(spark, sf_dir, "labels").join(docs, "doc_id").select("quality", F.least(F.col("n_chars") / 4000, F.lit(1.0)).alias("score"))
    cuts = rows.select("quality", F.explode(F.expr("filter(sequence(1, 9), t -> score * 10 >= t)")).alias("cut"))
    return cuts.groupBy("cut").agg(F.count("*").alias("taken"), F.sum("quality").alias("hit")).join(F.broadcast(rows.agg(F.sum("quality").alias("all")))).select("cut", "taken", "hit", (F.col("hit") / F.col("taken")).alias("precision"), (F.col("hit") / F.col("all")).alias("recall"))


PR_SQL = """WITH r AS (SELECT quality, least(n_chars / 4000, 1.0) AS score FROM labels JOIN documents USING (doc_id)), c AS (SELECT quality, unnest(range(1, 10)) AS cut, score FROM r)
SELECT CAST(cut AS INT) AS cut, count(*) AS taken, CAST(sum(quality) AS BIGINT) AS hit, sum(quality) / count(*) AS precision, sum(quality) / (SELECT sum(quality) FROM r) AS recall FROM c WHERE score * 10 >= cut GROUP BY cut"""


def confusion_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against toxicity, by language, by source and over all."""
    read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").createOrReplaceTempView("labelled_documents")
    return spark.sql("SELECT quality, toxic, lang, source, grouping_id() AS level, count(*) AS n FROM labelled_documents GROUP BY GROUPING SETS ((quality, toxic), (quality, toxic, lang), (quality, toxic, source))")


CONFUSION_SQL = "SELECT quality, toxic, lang, source, grouping_id(lang, source) AS level, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((quality, toxic), (quality, toxic, lang), (quality, toxic, source))"


def kernel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of inside events in each cell of (k, value / 50), counts spread to the neighbours with weights 2, 1 and shrunk by a prior of 3."""
    side = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type").isin("purchase", "signup"), 0)
    ev = events(spark, sf_dir).select(F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(F.col("value") / 50).alias("bin"), side.alias("side")).where("side is not null")
    cells = ev.groupBy("k", "bin").agg(F.sum("side").alias("ins"), F.count("*").alias("n"))
    spread = cells.select("k", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("to"), "bin", "ins", "n")
    weight = F.when(F.col("to") == F.col("bin"), 2).otherwise(1)
    return spread.groupBy("k", F.col("to").alias("bin")).agg(F.sum(weight * F.col("ins")).alias("ins"), F.sum(weight * F.col("n")).alias("n")).select("k", "bin", "ins", "n", ((F.col("ins") + 1.5) / (F.col("n") + 3)).alias("p"))


KERNEL_SQL = """WITH c AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(value / 50) AS BIGINT) AS bin, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS ins, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1, 2),
s AS (SELECT k, bin, unnest([bin - 1, bin, bin + 1]) AS b, ins, n FROM c)
SELECT k, b AS bin, CAST(sum(CASE WHEN b = bin THEN 2 ELSE 1 END * ins) AS BIGINT) AS ins, CAST(sum(CASE WHEN b = bin THEN 2 ELSE 1 END * n) AS BIGINT) AS n, (sum(CASE WHEN b = bin THEN 2 ELSE 1 END * ins) + 1.5) / (sum(CASE WHEN b = bin THEN 2 ELSE 1 END * n) + 3) AS p FROM s GROUP BY k, b"""


def density_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: the value (in cents) with most events within 500 cents; ties go to the smaller value."""
    ev = events(spark, sf_dir).select("event_type", F.expr("cast(round(value * 100) as bigint)").alias("v"))
    near = F.count("*").over(Window.partitionBy("event_type").orderBy("v").rangeBetween(-500, 500))
    best = F.max(F.struct("near", (-F.col("v")).alias("m")))
    return ev.withColumn("near", near).groupBy("event_type").agg(best.alias("b")).select("event_type", (-F.col("b.m")).alias("mode"), "b.near")


DENSITY_SQL = """WITH c AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY v RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY near DESC, v) AS rn FROM n) SELECT event_type, v AS mode, near FROM r WHERE rn = 1"""


def effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's value: its own by length, replaced by the interval its id falls into, unless a label overrides it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 500, "keep").otherwise("short").alias("piece"))
    spans = read_table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("first"), F.col("item_id").alias("sequence")).where("item_id % 2 = 0")
    covered = docs.withColumn("first", F.floor(F.col("doc_id") / 20) * 20).join(spans, "first", "left")
    over = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 0, "poor").alias("own"))
    return covered.join(over, "doc_id", "left").select("doc_id", F.coalesce("own", F.when(F.col("sequence").isNotNull(), F.lit("interval")), "piece").alias("value"), F.when(F.col("own").isNotNull(), "override").when(F.col("sequence").isNotNull(), "interval").otherwise("piece").alias("source"))


EFFECTIVE_SQL = """WITH s AS (SELECT item_id * 20 AS first FROM benchmark WHERE item_id % 2 = 0), o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 0 THEN 'poor' END AS own FROM labels)
SELECT doc_id, coalesce(own, CASE WHEN first IS NOT NULL THEN 'interval' END, CASE WHEN n_chars >= 500 THEN 'keep' ELSE 'short' END) AS value, CASE WHEN own IS NOT NULL THEN 'override' WHEN first IS NOT NULL THEN 'interval' ELSE 'piece' END AS source
FROM documents d LEFT JOIN s ON first = (doc_id // 20) * 20 LEFT JOIN o USING (doc_id)"""


def evidence_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions pinned to the text judged: those of every seventh document were made on another text and are stale."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("now"))
    made = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.col("now"), F.lit("x")), 256)).otherwise(F.col("now"))
    judged = read_table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("evidence", made)
    return judged.groupBy("quality").agg(F.count_if(F.col("evidence") == F.col("now")).alias("applied"), F.count_if(F.col("evidence") != F.col("now")).alias("stale"))


EVIDENCE_SQL = "WITH j AS (SELECT quality, sha256(text) AS now, CASE WHEN doc_id % 7 = 0 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS evidence FROM labels JOIN documents USING (doc_id)) SELECT quality, count(*) FILTER (evidence = now) AS applied, count(*) FILTER (evidence <> now) AS stale FROM j GROUP BY quality"


def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of an append-only store: the last event of each user and type."""
    last = F.max(F.struct("us", "event_id", "value"))
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(last.alias("m"), F.count("*").alias("history")).select("user_id", "event_type", "m.event_id", "m.us", "m.value", "history")


LATEST_SQL = f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS history FROM ev) SELECT user_id, event_type, event_id, us, value, history FROM r WHERE rn = 1"


def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows with status flags and a content key."""
    docs = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 0, "ambiguous").otherwise("confirmed")
    return docs.select("doc_id", status.alias("status"), (status == "confirmed").alias("usable"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", "text"), 256).alias("key"))


EXPORT_SQL = """WITH s AS (SELECT doc_id, lang, source, text, CASE WHEN quality IS NULL THEN 'unreviewed' WHEN toxic = 1 THEN 'excluded' WHEN quality = 0 THEN 'ambiguous' ELSE 'confirmed' END AS status FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, status, status = 'confirmed' AS usable, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, text)) AS key FROM s"""


def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of each language and source, by the md5 of their id."""
    w = Window.partitionBy("lang", "source").orderBy(F.md5(F.col("doc_id").cast("string")))
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.row_number().over(w).alias("turn")).where("turn <= 2")


STRATIFIED_SQL = "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS turn FROM documents) SELECT * FROM r WHERE turn <= 2"


def alternating_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of an uncertain list (nearest to 1,500 characters) and a random one (md5) in turns, without repeats."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    unsure = docs.orderBy(F.abs(F.col("n_chars") - 1500), "doc_id").limit(100)
    random = docs.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(100)
    w1, w2 = Window.orderBy(F.abs(F.col("n_chars") - 1500), "doc_id"), Window.orderBy(F.md5(F.col("doc_id").cast("string")))
    both = unsure.select("doc_id", ((F.row_number().over(w1) - 1) * 2).alias("place")).unionByName(random.select("doc_id", ((F.row_number().over(w2) - 1) * 2 + 1).alias("place")))
    return both.groupBy("doc_id").agg(F.min("place").alias("place"))


ALTERNATING_SQL = """WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY abs(n_chars - 1500), doc_id) - 1) * 2 AS place FROM documents), b AS (SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) * 2 + 1 AS place FROM documents)
SELECT doc_id, min(place) AS place FROM (SELECT * FROM a WHERE place < 200 UNION ALL SELECT * FROM b WHERE place < 200) GROUP BY doc_id"""


def retention_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: the newest documents whose running size stays within 100,000 characters."""
    w = Window.partitionBy("source").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    return read_table(spark, sf_dir, "documents").select("source", "doc_id", F.sum("n_chars").over(w).alias("running")).where("running <= 100000")


RETENTION_SQL = "WITH r AS (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) SELECT * FROM r WHERE running <= 100000"


def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (nations) whose dependencies (the nations before them in their region) are all done (even keys)."""
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    deps = n.join(n.select(F.col("n_nationkey").alias("dep"), "n_regionkey"), "n_regionkey").where("dep < n_nationkey and dep % 2 = 1")
    return n.join(deps, "n_nationkey", "left_anti").where("n_nationkey % 2 = 1").select("n_nationkey", "n_regionkey")


READY_SQL = "SELECT n_nationkey, n_regionkey FROM nation t WHERE n_nationkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM nation d WHERE d.n_regionkey = t.n_regionkey AND d.n_nationkey < t.n_nationkey AND d.n_nationkey % 2 = 1)"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users linked by an event in the same 20 seconds: the smallest user of each one's component."""
    active = events(spark, sf_dir).select(F.floor(F.col("us") / (60 * MINUTE // 180)).alias("s"), "user_id").distinct()
    star = active.join(active.groupBy("s").agg(F.min("user_id").alias("low"), F.count("*").alias("n")).where("n > 1"), "s").where("user_id <> low").select(F.col("user_id").alias("a"), F.col("low").alias("b"))
    return graph.components(star).select(F.col("node").alias("user_id"), F.col("root").alias("component"))


COMPONENTS_SQL = f"""WITH RECURSIVE {EV}, a AS (SELECT DISTINCT us // {60 * MINUTE // 180} AS s, user_id FROM ev), e AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM a x JOIN a y USING (s) WHERE x.user_id <> y.user_id),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node AS user_id, min(root) AS component FROM r GROUP BY node"""


def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("quality").alias("answered"), F.count_if(F.col("quality").isNull()).alias("open"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


COUNTERS_SQL = "SELECT source, count(quality) AS answered, count(*) FILTER (quality IS NULL) AS open, count(*) FILTER (quality = 1 AND toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups of a user paired one to one within a day, as many as possible."""
    ev = events(spark, sf_dir)
    return greedy.match_events(ev.where("event_type = 'purchase'"), ev.where("event_type = 'signup'"), ["user_id"], "event_id", "us", DAY)


def event_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.suppress(events(spark, sf_dir), ["user_id"], "event_id", "us", "value", HOUR)


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in small groups, as a day's clips would be."""
    return read_table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("bucket"), "vec_id", "embedding", F.pmod("vec_id", F.lit(5)).alias("camera"))


def online_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.online_people(_buckets(spark, sf_dir), ["bucket"], "vec_id", "embedding", 0.30)


def cannot_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.cannot_link_clusters(_buckets(spark, sf_dir), ["bucket"], "vec_id", "embedding", "camera", 0.5)


def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.cannot_link_clusters(_buckets(spark, sf_dir), ["bucket"], "vec_id", "embedding", "camera", 0.5, average=True)


def track_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-dimensional detections (value over hours), joined into tracks within each type and day."""
    seen = events(spark, sf_dir).select("event_type", F.floor(F.col("us") / DAY).alias("day"), "event_id", (F.col("us") / HOUR).alias("t"), F.col("value").alias("x"))
    return tracking.track(seen, ["event_type", "day"], "event_id", "t", ["x"], 5.0, 10.0, 3.0, 2)


QUERIES = {
    "prototypes": (prototypes, PROTOTYPES_SQL),
    "cosine_topk": (cosine_topk, TOPK_SQL),
    "fpr_gate": (fpr_gate, GATE_SQL),
    "pair_auc": (pair_auc, AUC_SQL),
    "purity_contingency": (purity_contingency, PURITY_SQL),
    "mutual_best_margin": (mutual_best_margin, MUTUAL_SQL),
    "idf1_assignment": (idf1_assignment, ""),
    "pr_curve": (pr_curve, PR_SQL),
    "confusion_sets": (confusion_sets, CONFUSION_SQL),
    "kernel_map": (kernel_map, KERNEL_SQL),
    "density_mode": (density_mode, DENSITY_SQL),
    "effective_value": (effective_value, EFFECTIVE_SQL),
    "evidence_pinned": (evidence_pinned, EVIDENCE_SQL),
    "latest_label": (latest_label, LATEST_SQL),
    "export_projection": (export_projection, EXPORT_SQL),
    "stratified_round_robin": (stratified_round_robin, STRATIFIED_SQL),
    "alternating_queue": (alternating_queue, ALTERNATING_SQL),
    "retention_running": (retention_running, RETENTION_SQL),
    "ready_tasks": (ready_tasks, READY_SQL),
    "components": (components, COMPONENTS_SQL),
    "queue_counters": (queue_counters, COUNTERS_SQL),
    "assign_events": (assign_events, ""),
    "event_nms": (event_nms, ""),
    "online_people": (online_people, ""),
    "cannot_link_join": (cannot_link_join, ""),
    "average_linkage": (average_linkage, ""),
    "track_assoc": (track_assoc, ""),
}
