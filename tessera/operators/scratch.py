"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Where that is unset: a temporary folder in local mode, else the warehouse."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            if app not in _own:
                _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
            base = _own[app]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-{app}"


def cut(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: what follows neither recomputes it nor depends on
    the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> bool:
    """Delete this application's folder; call it when no result built on it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
