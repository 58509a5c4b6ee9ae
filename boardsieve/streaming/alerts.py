"""Silence alerts as a named stateful processor (T5)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from boardsieve.functions import fixed_values as v

# Ship the processor itself to the executors: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000_000  # times are microseconds here


class SilenceProcessor(StatefulProcessor):
    """Emits (key, silent_from) for every silence of a key beyond the limit, once each.

    State per key: the last beat and whether its silence has been reported.  A timer stands at
    the end of the limit after the last beat; beats of one batch are reduced to the first and last per
    span of the limit's length, in which no longer silence can lie, so memory doesn't grow with the rows
    of a key.  Beats older than the last one are ignored.
    """

    def __init__(self, key: str, time: str, limit: int, ttl_ms: int | None):
        self.key, self.time, self.limit, self.ttl_ms = key, time, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "at LONG, reported BOOLEAN"
        self.last = handle.getValueState("last", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("last", schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans: dict[int, tuple[int, int]] = {}
        for frame in rows:
            times = frame[self.time].dropna().astype("datetime64[us]").astype("int64")
            for span, part in times.groupby(times // self.limit):
                low, high = spans.get(span, (part.min(), part.max()))
                spans[span] = (min(low, part.min()), max(high, part.max()))
        found = self._beats(sorted(spans.values()), timerValues)
        yield self._frame(key, found)

    def _beats(self, spans: list[tuple[int, int]], timerValues) -> list[int]:
        """Silences that the beats end; the last beat becomes the state, with its timer."""
        at, reported = (self.last.get() if self.last.exists() else None) or (None, False)
        found = []
        for low, high in spans:
            if at is not None and high <= at:
                continue
            if at is not None and low - at > self.limit and not reported:
                found.append(at)
            at, reported = int(high), False
        if at is not None:
            self._remember(at, reported, timerValues)
        return found

    def _remember(self, at: int, reported: bool, timerValues) -> None:
        self.last.update((at, reported))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not reported:
            due = (at + self.limit) // 1000 + 1
            self.handle.registerTimer(max(due, timerValues.getCurrentProcessingTimeInMs() + 1) if self.ttl_ms else due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        if known is None or known[1]:
            yield self._frame(key, [])
            return
        self.last.update((known[0], True))
        yield self._frame(key, [known[0]])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        times = initialState[self.time].dropna().astype("datetime64[us]").astype("int64")
        if len(times):
            self._remember(int(times.max()), False, timerValues)

    def _frame(self, key: tuple, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(times), dtype=object), "silent_from": pd.to_datetime(times, unit="us")})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start in this block keep their state in RocksDB, which named processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def silence_alerts(beats: DataFrame, key: str, time: str, hours: float = v.STALE_HOURS, known: DataFrame | None = None,
                   watermark: str | None = None, keep_hours: float = 24 * 31) -> DataFrame:
    """Streaming (``key``, ``silent_from``) of silences longer than ``hours``; start it inside :func:`rocksdb_state`.

    Without a watermark timers run on the clock, for which Spark triggers batches without any input
    too, so a silence of all keys is noticed; a key is forgotten ``keep_hours`` after its last beat.  With
    one they run on event time, which makes a replay of old beats give the same alerts however it is cut into
    batches.  ``known`` holds last beats from before the stream, for example of the scan log.
    """
    kind = dict(beats.dtypes)[key]
    rows = beats.select(key, time)
    if watermark is not None:
        rows = rows.withWatermark(time, watermark)
    ttl = None if watermark is not None else int(max(keep_hours, 2 * hours) * 3_600_000)
    processor = SilenceProcessor(key, time, int(hours * _HOUR), ttl)
    state = None if known is None else known.groupBy(key).agg(F.max(time).alias(time)).groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(
        processor, f"{key} {kind}, silent_from timestamp", "Append", "ProcessingTime" if ttl else "EventTime", state)
