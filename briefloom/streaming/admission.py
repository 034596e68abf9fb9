"""Admission over a stream: permits and starts of each key are state, which timers forget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import OUTPUT, Limiter, decisions

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that map state and timers need."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Admission(StatefulProcessor):
    """Per key: permits, a map from permit to start; starts of the window; one timer, for what is forgotten next."""

    def __init__(self, max_concurrent: int, max_starts: int, window_ms: int, lease_ms: int | None):
        self.limits = (max_concurrent, max_starts, window_ms, lease_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.permits = handle.getMapState("permits", "permit string", "since long")
        self.starts = handle.getValueState("starts", "at array<long>")

    def _limiter(self) -> Limiter:
        held = {p[0]: since[0] for p, since in self.permits.iterator()} if self.permits.exists() else {}
        return Limiter(*self.limits, held, self.starts.get()[0] if self.starts.exists() else ())

    def _store(self, before: dict[str, int], limiter: Limiter) -> None:
        """Writes what has changed; a key of which nothing is left has no state and no timer."""
        for permit in before.keys() - limiter.permits.keys():
            self.permits.removeKey((permit,))
        for permit, since in limiter.permits.items():
            if before.get(permit) != since:
                self.permits.updateValue((permit,), (since,))
        if limiter.starts:
            self.starts.update((list(limiter.starts),))
        else:
            self.starts.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (at := limiter.next_change()) is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = self._limiter()
        before = dict(limiter.permits)
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        batch["permit"] = batch["permit"].astype(object).where(batch["permit"].notna(), None)
        out = decisions([limiter.handle(r) for r in batch.itertuples(index=False)])
        self._store(before, limiter)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limiter = self._limiter()
        before = dict(limiter.permits)
        limiter.prune(expiredTimerInfo.getExpiryTimeInMs())
        self._store(before, limiter)
        yield decisions([])

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, max_concurrent: int = 4, max_starts: int = 12, window_ms: int = 60_000, lease_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """As ``operators.admission.admit``, for a stream of (key, seq, ts_ms, action, permit).

    Rows of a micro-batch are decided in order of time and seq; a row that arrives in a later batch is decided then, by its
    own time. The watermark follows the time of events, ``late`` behind: a row no newer than that when it arrives is dropped
    undecided, a release too, whose permit then lives until its lease ends. Rows without a time can't be placed and are
    left out, as are null keys.

    State is as small as its limits: starts are forgotten when the watermark leaves their window, permits at their release
    or the end of their lease, and a key without either has no state. Without a lease unreleased permits stay. A key's
    rows of one micro-batch are sorted in memory; the source's rate limit bounds them. Needs ``use_rocksdb``.
    """
    Limiter(max_concurrent, max_starts, window_ms, lease_ms)
    given = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("ts_ms").cast("long").alias("ts_ms"), "action", F.col("permit").cast("string").alias("permit"))
    given = given.where("key is not null and ts_ms is not null").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return given.groupBy("key").transformWithStateInPandas(Admission(max_concurrent, max_starts, window_ms, lease_ms), OUTPUT, "append", "eventTime")
