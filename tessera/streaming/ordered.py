"""Stateful operators that take events in order of event time: a circuit breaker and token buckets with timers.

Events wait by the minute until the watermark has passed it; a timer then hands the minute on, sorted. So the order in
which batches bring events within the watermark's delay changes nothing. State of a key that would be as good as new
is dropped by a timer of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Of the breaker: trailing seconds, calls needed, share of errors that opens it, seconds until a call tries it again.
WINDOW_S, LEAST_CALLS, SHARE, RESET_S = 300, 10, 0.10, 60
MINUTE_MS = 60_000


class Ordered(StatefulProcessor):
    """Holds a key's events back until their minute is over. Of each key, a minute of events is in memory at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute long", "at array<double>, failed array<boolean>")
        self.idle = handle.getValueState("idle", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for minute, part in frame.groupby((frame["at"] * 1000 // MINUTE_MS).astype("int64")):
                at, failed = part["at"].tolist(), part["failed"].tolist()
                if self.waiting.containsKey((minute,)):
                    old = self.waiting.getValue((minute,))
                    at, failed = [*old[0], *at], [*old[1], *failed]
                else:
                    self.handle.registerTimer((int(minute) + 1) * MINUTE_MS)
                self.waiting.updateValue((int(minute),), ([float(x) for x in at], [bool(x) for x in failed]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        minutes = sorted(m for (m,) in self.waiting.keys() if (m + 1) * MINUTE_MS <= now)
        for minute in minutes:
            at, failed = self.waiting.getValue((minute,))
            self.waiting.removeKey((minute,))
            yield self.events(str(key[0]), sorted(zip(at, failed, strict=True)))
        if minutes:
            until = int(self.idle_at() * 1000) + 1
            if self.idle.exists():
                self.handle.deleteTimer(int(self.idle.get()[0]))
            # A timer may not lie before the watermark; the next minute's end is always after it.
            until = max(until, timerValues.getCurrentWatermarkInMs() + 1)
            self.idle.update((until,))
            self.handle.registerTimer(until)
        elif self.idle.exists() and int(self.idle.get()[0]) == now:
            self.idle.clear()
            self.forget()
        if not minutes:
            yield from ()

    def close(self) -> None:
        pass


class TimedBreaker(Ordered):
    """Closed, it records calls and opens at a share of errors in the window; open, it refuses calls for a while; then
    one call tries it: a success closes it, a failure leaves it to the window."""

    def __init__(self, window_s: float, least_calls: int, share: float, reset_s: float):
        self.window_s, self.least_calls, self.share, self.reset_s = window_s, least_calls, share, reset_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.calls = handle.getListState("calls", "at double, failed boolean")
        self.open_since = handle.getValueState("open_since", "at double")
        self.last = 0.0

    def events(self, key: str, rows: list[tuple[float, bool]]) -> pd.DataFrame:
        calls = deque((float(c[0]), bool(c[1])) for c in self.calls.get()) if self.calls.exists() else deque()
        since = float(self.open_since.get()[0]) if self.open_since.exists() else None
        out, since = breaker_steps(calls, since, rows, self.window_s, self.least_calls, self.share, self.reset_s)
        self.calls.clear()
        if calls:
            self.calls.put(list(calls))
        if since is None:
            self.open_since.clear()
        else:
            self.open_since.update((since,))
        self.last = max(rows[-1][0], since or 0.0)
        return pd.DataFrame([(key, *r) for r in out], columns=["key", "at", "state", "calls", "errors"])

    def idle_at(self) -> float:
        return self.last + max(self.window_s, self.reset_s)

    def forget(self) -> None:
        self.calls.clear()
        self.open_since.clear()


def breaker_steps(calls: deque, since: float | None, rows: list[tuple[float, bool]], window_s: float, least_calls: int, share: float, reset_s: float) -> tuple[list[tuple], float | None]:
    """Changes of state (at, state, calls, errors) that calls in order bring; ``calls`` becomes the window after them."""
    out: list[tuple] = []
    errors = sum(failed for _, failed in calls)
    for at, failed in rows:
        tried = False
        if since is not None:
            if at - since < reset_s:
                continue
            since, tried = None, True
            out.append((at, "half_open", len(calls), errors))
        calls.append((at, failed))
        errors += failed
        while at - calls[0][0] > window_s:
            errors -= calls.popleft()[1]
        if tried and not failed:
            out.append((at, "closed", len(calls), errors))
        elif len(calls) >= least_calls and errors >= share * len(calls):
            since = at
            out.append((at, "open", len(calls), errors))
        elif tried:
            out.append((at, "closed", len(calls), errors))
    return out, since


def _rows(df: DataFrame, key: str, ts: str, failed: Column) -> DataFrame:
    # The event-time column stays, since the watermark is its.
    return df.select(F.col(key).cast("string").alias("key"), F.col(ts), F.col(ts).cast("double").alias("at"), failed.alias("failed"))


def timed_breaker(df: DataFrame, key: str, ts: str, failed: Column, window_s: float = WINDOW_S, least_calls: int = LEAST_CALLS, share: float = SHARE, reset_s: float = RESET_S) -> DataFrame:
    """Changes of each key's breaker, in order of event time: (key, at in epoch seconds, state, calls, errors).

    ``df`` is a stream with a watermark on ``ts``. What is later than the watermark is dropped; a minute's events give
    their rows once the watermark has passed the minute. Needs the RocksDB state store. A breaker that opened at a
    call that is the trial's is reported as half_open, then as open, at the same time.
    """
    processor = TimedBreaker(window_s, least_calls, share, reset_s)
    return _rows(df, key, ts, failed).groupBy("key").transformWithStateInPandas(processor, "key string, at double, state string, calls int, errors int", "Append", "EventTime")


class TimedBucket(Ordered):
    """A token bucket; once it would be full again it is forgotten."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.per_second = capacity, per_second

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.level = handle.getValueState("level", "tokens double, at double")
        self.full_at = 0.0

    def events(self, key: str, rows: list[tuple[float, bool]]) -> pd.DataFrame:
        tokens, last = (float(x) for x in self.level.get()) if self.level.exists() else (self.capacity, rows[0][0])
        passed = []
        for at, _ in rows:
            tokens, last = min(self.capacity, tokens + (at - last) * self.per_second), at
            passed.append(tokens >= 1)
            tokens -= tokens >= 1
        self.level.update((float(tokens), float(last)))
        self.full_at = last + (self.capacity - tokens) / self.per_second
        return pd.DataFrame({"key": key, "at": [at for at, _ in rows], "passed": passed})

    def idle_at(self) -> float:
        return self.full_at

    def forget(self) -> None:
        self.level.clear()


def timed_bucket(df: DataFrame, key: str, ts: str, capacity: float, per_second: float) -> DataFrame:
    """Which requests of each key pass, in order of event time: (key, at in epoch seconds, passed)."""
    return _rows(df, key, ts, F.lit(False)).groupBy("key").transformWithStateInPandas(TimedBucket(capacity, per_second), "key string, at double, passed boolean", "Append", "EventTime")
