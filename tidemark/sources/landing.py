"""The folder in which files land: one that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to drop a query's shuffle files when it has ended.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landing_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; under /tmp where that is unset in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


def land(df: DataFrame, what: str, kind: str = "csv", by: str | None = None) -> str:
    """Writes df as files of a kind, a folder for each value of by; gives the path to read."""
    path = landing_dir(df.sparkSession, what)
    writer = (df.repartition(by) if by else df).write
    if by:
        writer = writer.partitionBy(by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return f"{path}/*/*" if by else path


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: for steps that are stored, none of which reads another's shuffle."""
    before = spark.conf.get(DROP)
    spark.conf.set(DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP, before)


class Landed:
    """Tables that a job writes step by step, each without the shuffles of the step before, and removes at the end."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.number = spark, landing_dir(spark, what), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.path}/{self.number}"
        with dropped_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Only for when no lazy table reads what was stored any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
