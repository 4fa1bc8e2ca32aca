"""A corpus pipeline of training-data operators; each stage reads the rows its predecessor kept.

Stages filter or repeat whole documents; the last one writes token ids and returns their digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, table
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language_id import keep_identified
from tessera.llm.mixing import apply_mixture
from tessera.llm.simhash_dedup import keep_one_of_each_group
from tessera.llm.token_output import token_digest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeat or go so that domain token totals meet the target weights."""
    return apply_mixture(docs, table(spark, sf_dir, "labels"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as directly addressable codes; returns where each document's ids stand."""
    return token_digest(docs)


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("token id output", write_token_ids),
]

#: The trained models and hashes of these stages have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
