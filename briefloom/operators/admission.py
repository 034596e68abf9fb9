"""Admission under two limits: calls at one time, and starts within a sliding window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "key string, seq long, ts_ms long, action string, permit string, admitted boolean, reason string, retry_after_seconds int, active int, starts_in_window int"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class Limiter:
    """State of one key. A call over the concurrency limit is refused before the rate is looked at; refusals cost nothing.

    A start hands out a permit, and only the release that names it frees its place, once. With ``lease_ms`` a permit ends
    so long after its start, released or not.
    """

    def __init__(self, max_concurrent: int = 4, max_starts: int = 12, window_ms: int = 60_000, lease_ms: int | None = None, permits: Mapping[str, int] | None = None, starts: Iterable[int] = ()):
        for n in (max_concurrent, max_starts, window_ms, 1 if lease_ms is None else lease_ms):
            if n != int(n) or n <= 0:
                raise ValueError("limits, window and lease must be positive whole numbers")
        self.max_concurrent, self.max_starts, self.window_ms, self.lease_ms = max_concurrent, max_starts, window_ms, lease_ms
        self.permits, self.starts = dict(permits or {}), deque(starts)

    def prune(self, now: int) -> None:
        """Forgets starts that have left the window, and permits whose lease is over."""
        while self.starts and self.starts[0] <= now - self.window_ms:
            self.starts.popleft()
        if self.lease_ms is not None:
            self.permits = {p: since for p, since in self.permits.items() if since > now - self.lease_ms}

    def next_change(self) -> int | None:
        """When the next of them is forgotten."""
        ends = [self.starts[0] + self.window_ms] if self.starts else []
        ends += [since + self.lease_ms for since in self.permits.values()] if self.lease_ms is not None else []
        return min(ends, default=None)

    def acquire(self, now: int, permit: str) -> tuple[bool, str | None, int | None]:
        if permit in self.permits:  # the same call, told again
            return True, None, None
        if len(self.permits) >= self.max_concurrent:
            return False, "concurrency_limit", 1
        if len(self.starts) >= self.max_starts:
            return False, "rate_limit", max(1, -(-(self.starts[0] + self.window_ms - now) // 1000))
        self.permits[permit] = now
        self.starts.append(now)
        return True, None, None

    def handle(self, row: Any) -> tuple:
        if pd.isna(row.ts_ms):
            return (row.key, row.seq, None, row.action, row.permit, None, "invalid_time", None, len(self.permits), len(self.starts))
        now, out = int(row.ts_ms), (None, None, None)
        self.prune(now)
        if row.action == "release":
            self.permits.pop(row.permit, None)
        else:
            out = self.acquire(now, f"#{row.seq}" if row.permit is None else row.permit)
        return (row.key, row.seq, now, row.action, row.permit, *out, len(self.permits), len(self.starts))


def decisions(rows: Iterable[tuple]) -> pd.DataFrame:
    """A frame of OUTPUT."""
    return pd.DataFrame(list(rows), columns=_NAMES).astype({"seq": "Int64", "ts_ms": "Int64", "admitted": "boolean", "retry_after_seconds": "Int32", "active": "Int32", "starts_in_window": "Int32"})


def admit(events: DataFrame, max_concurrent: int = 4, max_starts: int = 12, window_ms: int = 60_000, lease_ms: int | None = None) -> DataFrame:
    """Decides each acquire of (key, seq, ts_ms, action, permit), key by key in order of time and seq; permit names the call.

    A release frees the place of the permit that it names: once, and nothing if that was refused, is unknown or null. An
    acquire that names a permit still held is the same call told again: admitted, without another place. One without a
    permit holds its place (till its lease ends). active and starts_in_window are the key's state after the row. A row
    without a time is not decided (reason ``invalid_time``); null keys are left out.

    Rows of a partition are sorted and streamed, so that no key's history is held: only its limiter is.
    """
    Limiter(max_concurrent, max_starts, window_ms, lease_ms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter, started = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if not started or row.key != key:
                    key, limiter, started = row.key, Limiter(max_concurrent, max_starts, window_ms, lease_ms), True
                out.append(limiter.handle(row))
            yield decisions(out)

    ordered = events.select("key", "seq", "ts_ms", "action", "permit").where("key is not null").repartition("key").sortWithinPartitions("key", "ts_ms", "seq")
    return ordered.mapInPandas(run, OUTPUT)
