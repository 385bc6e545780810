"""Steps of a job written to the folder that the cluster shares, and read back from there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def fresh_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; local sessions without that setting get one of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="textloom-steps-")
            atexit.register(shutil.rmtree, _OWN[app][7:], ignore_errors=True)
        base = _OWN[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once: every later use reads the same files, and a lost executor costs no recomputation."""
    path = fresh_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, *keys: str) -> DataFrame:
    """The same as an external table bucketed by ``keys``: grouping and windows by them, or by them and more, need no shuffle."""
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"textloom_step_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").option("path", fresh_dir(spark)).bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)
