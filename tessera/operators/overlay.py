"""Revisioned overlays: human corrections as an append-only log of operations over immutable base rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import per_group


def fingerprint(*columns: str) -> Column:
    """Content hash of a row: canonical JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def accepted(operations: DataFrame, keys: list[str]) -> DataFrame:
    """Operations (keys, seq, expected, ...) of optimistic writers that stand, with the ``revision`` each one made.

    In the order of ``seq`` an operation is taken if the revision it expected is the current one of its keys (at first 0);
    a stale or premature one is rejected and changes nothing. The logs of many keys stream through a task in order.
    """
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in operations.schema)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        revision, made = 0, []
        for expected in f["expected"]:
            taken = expected == revision
            revision += taken
            made.append(revision if taken else 0)
        return f.assign(revision=made)[np.array(made) > 0]

    return per_group(operations, keys, ["seq"], run, f"{rest}, revision bigint")


def latest(log: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last entry of every key."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_m"))
    return picked.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def effective(pieces: DataFrame, intervals: DataFrame, overrides: DataFrame) -> DataFrame:
    """(piece, frame, value): an observation's own override, unless a covering interval is later; else the last covering interval; else the piece's value.

    pieces (piece, frame, observation, value); intervals (piece, start, stop, value, sequence); overrides (observation, value, sequence).
    """
    cover = pieces.join(intervals.select("piece", "start", "stop", F.col("value").alias("v"), "sequence"), "piece").where("frame between start and stop")
    last = cover.groupBy("observation").agg(F.max(F.struct("sequence", "v")).alias("i"))
    own = latest(overrides, ["observation"], "sequence").select("observation", F.col("value").alias("o"), F.col("sequence").alias("os"))
    joined = pieces.join(last, "observation", "left").join(own, "observation", "left")
    value = F.when(F.col("os").isNotNull() & (F.col("i").isNull() | (F.col("os") >= F.col("i.sequence"))), F.col("o")).otherwise(F.coalesce("i.v", "value"))
    return joined.select("piece", "frame", "observation", value.alias("value"))


def pinned(decisions: DataFrame, now: DataFrame, ident: str) -> DataFrame:
    """Decisions (ident, evidence, ...) with ``applies``: the evidence judged is still what stands in ``now`` (ident, evidence)."""
    return decisions.join(now.select(ident, F.col("evidence").alias("_now")), ident, "left").withColumn("applies", F.coalesce(F.col("evidence") == F.col("_now"), F.lit(False))).drop("_now")
