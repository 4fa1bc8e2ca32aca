"""Boosted trees under a leave-one-fold-out protocol: a document's quality from counts of its text, languages as folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boosting
from ..operators.scratch import cut
from ..sources import read_table

_COUNTED = {"symbols": r"[^#*$%&|<>]+", "digits": "[^0-9]+", "capitals": "[^A-Z]+", "spaces": r"[^ \n]+", "lines": r"[^\n]+", "marks": r"[^.,;:!?]+"}
WIDTH = len(_COUNTED) + 1
SETTINGS = boosting.Settings(trees=10, depth=2, bins=24)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, x, y, fold) of the labelled documents; shares of an empty text are missing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    shares = [F.length(F.regexp_replace("text", p, "")) / F.when(size > 0, size) for p in _COUNTED.values()]
    x = F.array(F.when(size > 0, F.log(size)), *shares)
    known = read_table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    return docs.join(known, "doc_id").select("doc_id", x.alias("x"), "y", F.col("lang").alias("fold"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(examples(spark, sf_dir), "boosted-rows")
    folds = sorted(r["fold"] for r in rows.where("fold is not null").select("fold").distinct().collect())  # languages
    return cut(boosting.predict(rows, boosting.fit(rows, WIDTH, SETTINGS, folds), ["doc_id", "y", "fold"], WIDTH), "boosted-scores")


def boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every labelled document by the model that never saw its language."""
    return _scored(spark, sf_dir).select("doc_id", "fold", "y", "score")


def boosted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: the threshold that does best (F1, then the lowest) on the others' left-out scores, and what it does here."""
    cell = _scored(spark, sf_dir).where("score is not null").groupBy("fold", F.floor(F.col("score") * 50).alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    cell = cell.select("fold", "k", "n", "pos")  # 51 cells a language
    grid = spark.range(1, 50).select(F.col("id").alias("t"))
    upto = cell.join(F.broadcast(grid), F.lit(True)).groupBy("fold", "t").agg(F.sum(F.when(F.col("k") >= F.col("t"), F.col("n")).otherwise(0)).alias("told"), F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(0)).alias("right"), F.sum("pos").alias("pos"))
    every = Window.partitionBy("t")
    others = upto.select("*", *[(F.sum(c).over(every) - F.col(c)).alias(f"o_{c}") for c in ("told", "right", "pos")])
    f1 = F.coalesce(2 * F.col("o_right") / F.when(F.col("o_told") + F.col("o_pos") > 0, F.col("o_told") + F.col("o_pos")), F.lit(0.0))
    best = others.withColumn("_k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round(f1, 9)), "t"))).where("_k = 1")
    return best.select("fold", (F.col("t") / 50).alias("threshold"), "told", "right", "pos")


QUERIES = {"boosted_folds": (boosted_folds, None), "boosted_report": (boosted_report, None)}
