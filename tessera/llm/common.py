"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import cut, shared_dir

__all__ = ["cut", "free_name", "row_key", "shared_dir", "small_batches", "table"]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``rows`` rows, which bounds what a Python worker makes of whole texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that isn't a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name, dots and all, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list:
    return [F.col(quoted(c)) for c in df.columns]


def row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a text of two 64-bit hashes of every column, and that column's name: only wholly equal rows share it."""
    name = free_name(df, "_row")
    return df.withColumn(name, F.concat(F.hex(F.xxhash64(*all_of(df))), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *all_of(df))))), name
