import random
from collections import deque

import pytest

from briefloom.operators import admission
from briefloom.streaming.admission import admit_stream, use_rocksdb

SCHEMA = "key string, seq long, ts_ms long, action string, permit string"


def folded(events, most, starts, window, lease=None):
    """Decisions by a plain loop over events as they come; a permit is a place that only its own release gives back."""
    out, held, begun = {}, {}, {}
    for key, seq, ts, action, permit in events:
        own, times = held.setdefault(key, {}), begun.setdefault(key, deque())
        while times and times[0] <= ts - window:
            times.popleft()
        for p in [p for p, since in own.items() if lease is not None and since <= ts - lease]:
            del own[p]
        told = (None, None, None)
        if action == "release":
            own.pop(permit, None)
        elif permit is not None and permit in own:
            told = (True, None, None)
        elif len(own) >= most:
            told = (False, "concurrency_limit", 1)
        elif len(times) >= starts:
            told = (False, "rate_limit", max(1, -(-(times[0] + window - ts) // 1000)))
        else:
            own[permit or f"#{seq}"] = ts
            times.append(ts)
            told = (True, None, None)
        out[key, seq] = (*told, len(own), len(times))
    return out


def _in_order(events):
    return sorted((e for e in events if e[0] is not None), key=lambda e: (e[0], e[2], e[1]))


def _events(n, seed, first=0, ts=0):
    """Calls with and without permits; releases of calls that run, were refused, are unknown or have been released."""
    rng, rows = random.Random(seed), []
    for seq in range(first, first + n):
        ts += rng.choice([0, 1, 400, 5000, 61_000])
        key, action = rng.choice(["a", "b", "c", None, ""]), rng.choice(["acquire", "acquire", "release"])
        permit = rng.choice([f"p{seq}", f"p{seq}", f"p{max(0, seq - 3)}", None]) if action == "acquire" else rng.choice([f"p{max(0, seq - k)}" for k in range(1, 12)] + [None])
        rows.append((key, seq, ts, action, permit))
    return rows


def _told(rows):
    return {(r["key"], r["seq"]): (r["admitted"], r["reason"], r["retry_after_seconds"], r["active"], r["starts_in_window"]) for r in rows}


def test_batch_against_a_fold(spark):
    events = _events(600, 1)
    frame = spark.createDataFrame(events, SCHEMA)
    for limits in ((4, 12, 60_000), (1, 2, 5_000), (50, 3, 60_000), (2, 12, 60_000, 100_000)):
        assert _told(admission.admit(frame, *limits).collect()) == folded(_in_order(events), *limits)
    assert admission.admit(frame.where("seq < 0")).count() == 0


def test_a_permit_is_released_once(spark):
    rows = [("k", 0, 0, "acquire", "a"), ("k", 1, 1, "acquire", "b"), ("k", 2, 2, "release", "a"), ("k", 3, 3, "release", "a"), ("k", 4, 4, "acquire", "c"), ("k", 5, 5, "acquire", "d"), ("k", 6, 6, "release", "d"), ("k", 7, 7, "acquire", "e"), ("k", 8, 8, "acquire", "c"), ("k", 9, None, "acquire", "f")]
    got = sorted(admission.admit(spark.createDataFrame(rows, SCHEMA), 2, 12).collect(), key=lambda r: r["seq"])
    assert [r["active"] for r in got[:9]] == [1, 2, 1, 1, 2, 2, 2, 2, 2]
    assert [r["admitted"] for r in got] == [True, True, None, None, True, False, None, False, True, None] and got[9]["reason"] == "invalid_time"


@pytest.mark.parametrize("limits", [(0, 1, 1), (1, -1, 1), (1, 1, 0.5), (1, 1, 1, 0)])
def test_limits_are_positive(spark, limits):
    with pytest.raises(ValueError):
        admission.admit(spark.createDataFrame([], SCHEMA), *limits)


def _stream(spark, tmp_path, batches, limits, **more):
    """What a stream tells of each batch, and how many keys have state after it."""
    use_rocksdb(spark)
    source, out, states = str(tmp_path / "events"), [], []
    (tmp_path / "events").mkdir()
    frame = admit_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), *limits, **more)
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        started = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        started.awaitTermination(300)
        assert started.exception() is None
        out.append(_told(spark.read.parquet(str(tmp_path / "out")).collect()))
        states.append(started.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, states


def test_stream_of_batches_against_a_fold(spark, tmp_path):
    """The second batch holds rows that are older than some of the first, within the watermark."""
    events = _events(300, 2, ts=1_000_000)
    early = [e for i, e in enumerate(events) if i < 150 or 170 <= i < 185]
    later = [e for i, e in enumerate(events) if 150 <= i < 170 or i >= 185]
    out, _ = _stream(spark, tmp_path, [early, later], (2, 5, 60_000, 200_000), late="1 hour")
    assert out[-1] == folded(_in_order(early) + _in_order(later), 2, 5, 60_000, 200_000)


def test_stream_forgets_idle_keys_and_late_rows(spark, tmp_path):
    hour = 3_600_000
    first = [("a", 0, 1, "acquire", "p"), ("b", 1, 10, "acquire", "q"), ("b", 2, 20, "release", "q")]
    second, third = [("c", 3, hour, "acquire", "r")], [("a", 4, 5, "release", "p"), ("a", 5, hour + 5, "acquire", "s")]
    out, states = _stream(spark, tmp_path, [first, second, third], (1, 5, 60_000, 600_000))
    assert ("a", 4) not in out[-1], "older than the watermark"
    assert out[-1]["a", 5] == (True, None, None, 1, 1), "the lease of p is over"
    assert set(out[-1]) == {("a", 0), ("b", 1), ("b", 2), ("c", 3), ("a", 5)} and states[1] < states[0] + 3
