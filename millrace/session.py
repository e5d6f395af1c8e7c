"""A Spark session with the settings that the engine is meant to run with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: On a cluster, shuffle partitions are sized at run time from this many upwards.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(**settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("millrace")
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder; what is written there goes when the driver ends.

    The folder is spark.checkpoint.dir; where that is unset and Spark runs in one
    machine, a local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared}/millrace/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Places of the tables that are cut in the innermost cuts_dropped().
_CUTS: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


@contextmanager
def cuts_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut in here go at its end, not only when the driver ends."""
    token = _CUTS.set([])
    try:
        yield
    finally:
        for path in _CUTS.get():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _CUTS.reset(token)


def cut(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """df, written as Parquet to the shared folder and read again, so that what is built on it has a short plan and a lost executor costs no recomputation of it; most: rows in a file, 0 for as many as a task has."""
    path = shared_path(df.sparkSession, name)
    if (cuts := _CUTS.get()) is not None:
        cuts.append(path)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
