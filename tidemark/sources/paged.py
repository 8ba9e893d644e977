"""Paged answers as a Spark data source: a partition per key and page, and page counts as the offsets of a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class _Page(InputPartition):
    def __init__(self, key: str, number: int):
        self.key, self.number = key, number


def paged(spark: SparkSession, name: str, schema: str, keys: list[str], pages: Callable[[str], int], page: Callable[[str, int], list[tuple]], tries: int = 3, pause: float = 0.0) -> str:
    """Registers a source of that name, for spark.read and spark.readStream, and gives the name back.

    pages(key) says how many pages a key has now, and page(key, number) gives the rows of one, from 0 on; both run in
    Python workers, so they have to reach their store from any machine. A page is a partition: it is asked for up to
    tries times, pause seconds apart, and read anew with its task. A stream reads the pages that each key has more than
    at the last batch; pages may be added, and don't change.
    """

    class Batch(DataSourceReader):
        def partitions(self) -> list[_Page]:
            return [_Page(k, n) for k in keys for n in range(pages(k))]

        def read(self, partition: _Page) -> Iterator[tuple]:
            for left in range(tries - 1, -1, -1):
                try:
                    rows = page(partition.key, partition.number)
                    break
                except Exception:
                    if not left:
                        raise
                    time.sleep(pause)
            yield from rows

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {}

        def latestOffset(self) -> dict:  # noqa: N802
            return {k: pages(k) for k in keys}

        def partitions(self, start: dict, end: dict) -> list[_Page]:
            return [_Page(k, n) for k in end for n in range(start.get(k, 0), end[k])]

        def read(self, partition: _Page) -> Iterator[tuple]:
            return Batch().read(partition)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
            return Batch()

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802, ARG002
            return Stream()

    spark.dataSource.register(Source)
    return name


def landed_pages(path: str) -> tuple[Callable[[str], int], Callable[[str, int], list[dict]]]:
    """pages and page over JSON lines landed under path/key=<key>/page=<number>, in any store that Arrow reaches."""

    def files(key: str, number: int | None = None) -> list:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path)
        at = f"{root}/key={key}" + ("" if number is None else f"/page={number}")
        return [(store, f) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]

    def pages(key: str) -> int:
        return max((int(f.base_name[5:]) + 1 for _, f in files(key) if f.base_name.startswith("page=")), default=0)  # a number that has nothing is an empty page

    def page(key: str, number: int) -> list[dict]:
        import json

        out = []
        for store, f in files(key, number):
            if f.base_name.endswith(".json") and not f.base_name.startswith("."):
                with store.open_input_stream(f.path) as s:
                    out += [json.loads(line) for line in s.read().decode().splitlines() if line]
        return out

    return pages, page
