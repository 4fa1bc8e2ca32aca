"""Readers. Event time is an integer number of microseconds, so equality joins and differences are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOOR_SCHEMA = "event_id string, unix_ms bigint, event string, role string, global_id string, track_id string, foot_x double, foot_y double, staff_probability double, detection_confidence double, broken string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with ``us`` for its time."""
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros("ts").alias("us"))


def read_door_log(spark: SparkSession, path: str) -> DataFrame:
    """A live JSON-lines door log: a half-written last line and other broken ones are left out, repeated event ids read once."""
    raw = spark.read.schema(DOOR_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return raw.where("broken is null and event_id is not null").drop("broken").dropDuplicates(["event_id"])
