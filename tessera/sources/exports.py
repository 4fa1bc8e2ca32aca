"""Immutable exports keyed by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_key(df: DataFrame) -> str:
    """A key of the rows that depends neither on their order nor on the partitions: count and sums of two row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    got = df.select(row.alias("r")).agg(F.count("*"), total(F.xxhash64("r")), total(F.xxhash64("r", F.lit(1)))).first()
    return "-".join(str(x or 0) for x in got).replace("--", "-m")


def write_export(df: DataFrame, folder: str) -> str:
    """Write ``df`` as JSON lines under ``folder``/key and return that path; the same content is never written twice."""
    path = f"{folder.rstrip('/')}/{content_key(df)}"
    df.write.mode("ignore").json(path)
    return path
