"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of characters other than space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Spark's setting to drop a query's shuffle files when it has ended.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_az(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach. Where it is unset, one under /tmp in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: cuts the lineage, and survives the loss of executors."""
    return Scratch(df.sparkSession).written(df, what, **options)


class Scratch:
    """Tables that a job writes into the shared folder, and that go when what is made of them is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.number = spark, shared_dir(spark), 0

    def written(self, df: DataFrame, what: str, **options: str) -> DataFrame:
        self.number += 1
        path = f"{self.path}/{self.number}-{what}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs: it does so once the driver's garbage is collected."""
        self.spark._jvm.System.gc()

    def remove(self) -> None:
        """Delete all that was written; only for when no lazy table reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files, however long the driver keeps their plans: for steps that are stored, none of which reads another's shuffle."""
    before = spark.conf.get(DROP)
    spark.conf.set(DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP, before)
