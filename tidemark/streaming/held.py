"""Held positions as keyed state with timers: a stretch is sent out by its own expiry, and its state goes then."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: What keyed state with timers needs as its store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(stretches: list[tuple[int, int, int]], at: list[int], reach: int) -> list[tuple[int, int, int]]:
    """(first, last, number) of each stretch with more alerts, in any order: one by reach after another, that moment included, is in its stretch."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*stretches, *((x, x, 1) for x in at)]):
        if out and first <= out[-1][1] + reach:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Holding(StatefulProcessor):
    """Per key the stretches that haven't run out (a handful: those within the watermark's delay), and a timer at the end of each."""

    def __init__(self, key: str, days: int):
        self.key, self.reach = key, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "first array<long>, last array<long>, n array<long>")

    def _read(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def _write(self, stretches: list[tuple[int, int, int]]) -> None:
        if stretches:
            self.state.update(tuple(list(c) for c in zip(*stretches, strict=True)))
        else:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._read()
        now = merged(before, [int(t) for frame in rows for t in frame["at"]], self.reach)
        for due in {last for _, last, _ in before} - {last for _, last, _ in now}:
            self.handle.deleteTimer(due + self.reach + 1)
        for due in {last for _, last, _ in now} - {last for _, last, _ in before}:
            self.handle.registerTimer(due + self.reach + 1)
        self._write(now)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        stretches = self._read()
        over = [s for s in stretches if s[1] + self.reach + 1 == due]
        self._write([s for s in stretches if s not in over])
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(over), dtype=object), "since": [s[0] for s in over], "until": [s[1] + self.reach for s in over], "alerts": [s[2] for s in over]})

    def close(self) -> None:
        pass


def expiring(alerts: DataFrame, key: str = "scrip_code", ts: str = "ts", days: int = 180, late: str = "0 seconds") -> DataFrame:
    """key, since, expires, alerts of each stretch of a stream that has run out: held for days after each alert.

    The watermark is late behind the newest alert. When it passes a stretch's end, the stretch's timer sends it out and
    its state goes; an alert by then, the last moment included, puts the end off. Rows later than the watermark are
    dropped. The stream has to be started with the state store PROVIDER.
    """
    rows = alerts.withWatermark(ts, late).withColumn("at", F.unix_millis(ts)).select(key, ts, "at")
    kind = alerts.schema[key].dataType.simpleString()
    out = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Holding(key, days), outputStructType=f"{key} {kind}, since long, until long, alerts long", outputMode="Append", timeMode="EventTime")
    return out.select(key, F.timestamp_millis("since").alias("since"), F.timestamp_millis("until").alias("expires"), "alerts")
