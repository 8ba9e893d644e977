"""A table in buckets by key: a merge reads and writes the buckets that its rows fall into, and no others."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changed(RuntimeError):
    """Another run has committed since this one read the table."""


class Keyed:
    """Rows under path, in a number of buckets by the hash of their keys.

    A run's files are in a folder of their own, and a small text with the commit's number says for each bucket which
    folder holds it; readers go by the newest one. A number can be taken once: of two runs that started from the
    same commit the second fails, and has left nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def head(self) -> tuple[int, dict[str, str]]:
        """The newest commit's number, and of each bucket that has rows the folder that holds it."""
        found = [int(f.getPath().getName().split("-")[1]) for f in self._fs.globStatus(self._path(f"{self.path}/commit-*")) or ()]
        if not found:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/commit-{max(found)}", wholetext=True).first()[0]
        return max(found), json.loads(text)

    def _commit(self, number: int, where: dict[str, str]) -> None:
        if self._fs.exists(self._path(f"{self.path}/commit-{number}")):
            raise Changed(f"commit {number} is taken")
        try:
            out = self._fs.create(self._path(f"{self.path}/commit-{number}"), False)
        except Exception as e:
            raise Changed(f"commit {number} is taken") from e
        out.write(json.dumps(where).encode())
        out.close()

    def read(self, schema: str, only: list[int] | None = None, at: dict[str, str] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        where = self.head()[1] if at is None else at
        folders = [f"{self.path}/{n}/__bucket={b}" for b, n in where.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts how(old, new) in the place of the buckets that new's rows fall into, and gives their numbers. how goes by the keys, so that a bucket's rows come from its own."""
        number, where = self.head()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        run = self.spark._jvm.java.util.UUID.randomUUID().toString()  # a run that loses the race overwrites nothing
        new.write.parquet(f"{self.path}/new-{run}")
        new = self.spark.read.schema(schema).parquet(f"{self.path}/new-{run}")
        changed = sorted(r[0] for r in self._of(new).select("__bucket").distinct().collect())
        if not changed:
            return []
        out = how(self.read(schema, changed, where), new)
        folder = f"data-{number + 1}-{run}"
        self._of(out).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        written = {b for b in changed if self._fs.exists(self._path(f"{self.path}/{folder}/__bucket={b}"))}
        self._commit(number + 1, {b: n for b, n in where.items() if int(b) not in changed} | {str(b): folder for b in sorted(written)})
        self._fs.delete(self._path(f"{self.path}/new-{run}"), True)
        return changed
