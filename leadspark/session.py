"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def build_session(app_name: str = "leadspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time; ``settings`` override."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the session's warehouse if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def staged_dir(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{shared_dir(spark).rstrip('/')}/leadspark/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never used twice."""
    return f"{staged_dir(spark)}/{_SCRATCH.get()}{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end; write what is to stay to a path taken before it."""
    before = _SCRATCH.get()
    token = _SCRATCH.set(f"{before}scratch-{uuid.uuid4().hex[:12]}/")
    folder = f"{staged_dir(spark)}/{_SCRATCH.get()}"
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete_path(spark, folder)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once, to ``path`` or a fresh one, and read it back: cuts lineage and survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def delete_path(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, once nothing that reads it is left to run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Delete the table that ``stage`` wrote for ``df``, once nothing that reads it is left to run."""
    delete_path(df.sparkSession, df.staged_path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application; call it once nothing that reads them is left to run."""
    delete_path(spark, staged_dir(spark))
