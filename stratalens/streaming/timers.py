"""Operators with state and timers: requests that time out, and batches that are flushed by size or time.

Both keep one small state per key that a timer ends, so that state is bounded by the keys that are open.  Each
has a batch twin over the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times are whole milliseconds since 1970 in state, timers and rows, whatever the session's time zone.
_ANSWERED = "key string, asked_ms long, status string, waited_ms long"
_FLUSHED = "key string, first_ms long, n long, cause string"


class Requests(StatefulProcessor):
    """A request waits for the next answer of its key; after ``timeout_ms`` of event time it is given up.

    A request while one is open replaces it, and the earlier one is given up.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at_ms long, waited_for long")

    def _row(self, key: tuple, asked: int, status: str, waited: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "asked_ms": [asked], "status": [status], "waited_ms": [waited]})

    def _end(self) -> None:
        _, due = self.open.get()
        self.handle.deleteTimer(due)
        self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "kind"], kind="stable")
        for now, kind in zip(events["at_ms"].tolist(), events["kind"], strict=True):
            if self.open.exists():
                asked, due = self.open.get()
                if now > due or kind == "request":
                    yield self._row(key, asked, "timed_out", self.timeout_ms)
                else:
                    yield self._row(key, asked, "answered", now - asked)
                self._end()
            if kind == "request":
                self.open.update((now, now + self.timeout_ms))
                self.handle.registerTimer(now + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            asked, due = self.open.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._row(key, asked, "timed_out", self.timeout_ms)

    def close(self) -> None:
        pass


class Flushes(StatefulProcessor):
    """Events of a key are gathered and flushed when there are ``size`` of them, or ``wait_ms`` after the first."""

    def __init__(self, size: int, wait_ms: int) -> None:
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first_ms long, n long")

    def _row(self, key: tuple, first: int, n: int, cause: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "first_ms": [first], "n": [n], "cause": [cause]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for now in sorted(pd.concat(list(rows))["at_ms"].tolist()):
            first, n = self.held.get() if self.held.exists() else (now, 0)
            if n and now > first + self.wait_ms:
                self.handle.deleteTimer(first + self.wait_ms)
                yield self._row(key, first, n, "time")
                first, n = now, 0
            n += 1
            if n == self.size:
                if n > 1:
                    self.handle.deleteTimer(first + self.wait_ms)
                self.held.clear()
                yield self._row(key, first, n, "size")
                continue
            if n == 1:
                self.handle.registerTimer(now + self.wait_ms)
            self.held.update((first, n))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            first, n = self.held.get()
            if first + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield self._row(key, first, n, "time")

    def close(self) -> None:
        pass


def _timed(events: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """The state store must be RocksDB's, which transformWithState asks for."""
    timed = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def answered(events: DataFrame, timeout_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, asked_at, status (answered or timed_out) and waited_ms of every request of a stream of (key, at, kind)."""
    out = _timed(events, Requests(timeout_ms), _ANSWERED, late)
    return out.select("key", F.timestamp_millis("asked_ms").alias("asked_at"), "status", "waited_ms")


def flushed(events: DataFrame, size: int, wait_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, first_at, n, cause (size or time) of every flush of a stream of (key, at)."""
    out = _timed(events, Flushes(size, wait_ms), _FLUSHED, late)
    return out.select("key", F.timestamp_millis("first_ms").alias("first_at"), "n", "cause")


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` while the session keeps state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(key, before)


def answered_table(events: DataFrame, timeout_ms: int) -> DataFrame:
    """The batch twin of ``answered``: what follows a request in its key decides."""
    w = Window.partitionBy("key").orderBy("at", "kind")
    e = events.withColumn("next_at", F.lead("at").over(w)).withColumn("next_kind", F.lead("kind").over(w)).where("kind = 'request'")
    waited = F.unix_millis("next_at") - F.unix_millis("at")
    ok = F.coalesce((F.col("next_kind") == "answer") & (waited <= timeout_ms), F.lit(False))
    return e.select(F.col("key").cast("string").alias("key"), F.col("at").alias("asked_at"), F.when(ok, "answered").otherwise("timed_out").alias("status"), F.when(ok, waited).otherwise(timeout_ms).cast("long").alias("waited_ms"))
