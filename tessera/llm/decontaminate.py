"""Benchmark decontamination: MinHash containment search over size partitions, verified by exact shingle containment.

DataFrame functions only. A text's 5-word shingles are hashed to 64 bits. Documents are partitioned by the number of their
distinct shingles, n: those with 2^(p-1) < n <= 2^p get a one-permutation MinHash signature with 2^(p+c) bins, so a long
document keeps a signature in proportion to its size and a short test item inside it is not drowned, as it would be with
one signature length for all. The signature is the smallest hash of each bin. A document is a candidate for an item when
one of its minima is a shingle of the item. A shared shingle fails to be its bin's minimum with a probability of at most
0.37 (c = 0) or 0.21 (c = 1); c follows from the smallest item so that an item at the threshold is missed with a
probability of at most one in a million, and items too short for that are searched among all hashes (an exact way).
Candidates are verified on the words themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, cut, free_name, table

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-6
#: Distinct item shingles up to which they are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: str | Column = "text") -> Column:
    """Lower-cased runs of letters and digits; null and empty texts give none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), NOT_WORD), "")


def _hashed(df: DataFrame) -> DataFrame:
    """Adds ``sh``: the distinct shingle hashes of ``w``. Fewer than five words: one hash of them all; none: no hash."""
    df = df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    whole = F.array(F.xxhash64(F.concat_ws(" ", "w"), F.size("w")))
    rolled = F.transform(F.slice("wh", 1, F.size("wh") - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get("wh", i + k) for k in range(1, SHINGLE)]))
    sh = F.when(F.size("wh") >= SHINGLE, rolled).when(F.size("wh") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("sh", F.array_distinct(sh))


def _shingle_texts() -> Column:
    return F.array_distinct(
        F.when(F.size("w") >= SHINGLE, F.transform(F.slice("w", 1, F.size("w") - (SHINGLE - 1)), lambda x, i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(SHINGLE)])))
        .when(F.size("w") > 0, F.array(F.concat_ws(" ", "w")))
        .otherwise(F.array().cast("array<string>"))
    )


def _spare_bits(least_matched: int) -> int | None:
    """Extra signature bits c so that missing all matched shingles has a probability of at most MISS; None: no signature is long enough."""
    for c in range(4):
        per_bin = 2.0**-c  # shingles a bin, at most
        hit = (1 - math.exp(-per_bin)) / per_bin
        if (1 - hit) ** least_matched <= MISS:
            return c
    return None


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (row, item_id, n_item, n_shared, containment) for every distinct (doc_id, text) and item at or above the threshold.

    ``row`` is the hash of doc_id and text. Items without words match nothing; items of fewer than five words match
    documents of exactly those words. Null texts hold nothing. Repeated documents are reported once, repeated items each
    under their own id (a null item_id included).
    """
    key = F.xxhash64("doc_id", "text").alias("row")
    item = items.select("item_id", word_array().alias("w")).where("size(w) > 0").withColumn("item", F.xxhash64("item_id", "w")).dropDuplicates(["item"])
    item = cut(item.withColumn("shingles", _shingle_texts()).transform(_hashed).select("item", "item_id", "shingles", "sh", F.size("shingles").alias("n_item")), "op4-items")
    sizes = item.agg(F.min("n_item").alias("least"), F.sum("n_item").alias("total")).first()
    spare = _spare_bits(math.ceil(threshold * sizes["least"] - 1e-9)) if sizes["least"] else 0
    probe = _hashed(docs.select(key, word_array().alias("w"))).select("row", "sh")
    if spare is not None:  # size partition p, then the smallest hash of each of its bins
        bits = F.ceil(F.log2(F.greatest(F.size("sh"), F.lit(1)))).cast("int") + spare
        probe = probe.select("row", F.sort_array("sh").alias("s"), (F.lit(64) - F.greatest(bits, F.lit(1))).alias("drop"))
        probe = probe.select("row", F.filter("s", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("s", i - 1)))).alias("sh"))
    wanted = item.select(F.explode_outer("sh").alias("h"), "item")
    if (sizes["total"] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # explode_outer: with explode, the optimizer pushes a filter on "sh" below the steps that make it and repeats them.
    candidates = cut(probe.select("row", F.explode_outer("sh").alias("h")).join(wanted, "h").select("row", "item").distinct(), "op4-candidates")
    texts = docs.select(key, "text").join(candidates.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    held = texts.select("row", word_array().alias("w")).withColumn("shingles", _shingle_texts()).select("row", F.explode_outer("shingles").alias("s"))
    asked = candidates.join(item.select("item", F.explode_outer("shingles").alias("s")), "item")
    shared = asked.join(held, ["row", "s"]).groupBy("row", "item").agg(F.count("*").alias("n_shared"))
    out = shared.join(item.select("item", "item_id", "n_item"), "item").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return out.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)).select("row", "item_id", "n_item", "n_shared", "containment")


def _bin(x: Column) -> Column:
    """The bin of a hash: its leading bits; ``drop`` of the row says how many go."""
    return F.call_function("shiftright", x, F.col("drop"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment)."""
    found = cut(contained_items(docs, items, threshold), "op4-found")
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(found.select("row").distinct(), "row", "left_semi").distinct()
    return found.join(ids, "row").select("doc_id", "item_id", F.col("n_item").cast("bigint"), "n_shared", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: the documents that hold no item, with all their columns."""
    key = free_name(docs, "_row")
    found = cut(contained_items(docs, items, threshold).select(F.col("row").alias(key)).distinct(), "op4-rows")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left_anti").select(*all_of(docs))


def op4_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql() -> str:
    """Every item against every document by exact shingle sets."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    sets = "CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH d AS (SELECT doc_id, {sets} AS s FROM (SELECT DISTINCT doc_id, {split} AS w FROM documents)),
b AS (SELECT item_id, {sets} AS s FROM (SELECT item_id, {split} AS w FROM benchmark)),
dx AS (SELECT doc_id, unnest(s) AS g FROM d), bx AS (SELECT item_id, unnest(s) AS g, len(s) AS n_item FROM b)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM dx JOIN bx USING (g) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil({THRESHOLD} * n_item - 1e-9)"""
