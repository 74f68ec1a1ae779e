"""Rules that remember, as state of a stream: throttles, the circuit breaker, the alert store.

Each key has a few numbers of state, kept in the state store and so in the checkpoint: a query that is started again
goes on where it was. They give what the batch rules of ``operators.queue`` and ``operators.monitor`` give over all rows,
as long as a key's rows come in order of time from one micro-batch to the next; within one they are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.operators.queue import BREAKER_AFTER, BREAKER_SECONDS
from vitrine.sources.catalogue import _struct

PASSED = _struct("k string, at bigint")
CALLS = _struct("k string, at bigint, outcome string, state string, failures bigint")
ALERTS = _struct("code string, severity string, message string, n bigint, first_seen bigint, last_seen bigint, state string")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESOLVED_AFTER_S = 3600  # without a sign of an alert


class _Keyed(StatefulProcessor):
    """A state of named numbers and texts for each key, and what a row makes of it."""

    STATE = T.StructType()
    ORDER: tuple[str, ...] = ("at",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, key: str, state: tuple, row: Row) -> tuple[tuple, Row | None]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else self.begin()
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.ORDER)):
            state, out = self.step(key[0], state, row)
            if out is not None:
                yield out
        self.state.update(state)


class Throttle(_Keyed):
    """Rows (k, at) that pass at most once in so many seconds by key."""

    STATE = _struct("last bigint")

    def __init__(self, seconds: int):
        self.seconds = seconds

    def begin(self) -> tuple:
        return (-(1 << 60),)

    def step(self, key: str, state: tuple, row: Row) -> tuple[tuple, Row | None]:
        return ((row["at"],), Row(k=key, at=row["at"])) if row["at"] - state[0] >= self.seconds else (state, None)


class Breaker(_Keyed):
    """Calls (k, at, outcome ok, fail or ignored) with the breaker's state behind each: so many failures in a row open it for some seconds; calls that come meanwhile are refused and change nothing."""

    STATE = _struct("fails bigint, until bigint")
    ORDER = ("at", "outcome")

    def __init__(self, after: int = BREAKER_AFTER, seconds: int = BREAKER_SECONDS):
        self.after, self.seconds = after, seconds

    def begin(self) -> tuple:
        return (0, 0)

    def step(self, key: str, state: tuple, row: Row) -> tuple[tuple, Row | None]:
        (fails, until), at, outcome = state, row["at"], row["outcome"]
        if at < until:
            return state, Row(k=key, at=at, outcome=outcome, state="refused", failures=fails)
        fails = 0 if outcome == "ok" else fails + (outcome == "fail")
        if fails >= self.after:
            return (0, at + self.seconds), Row(k=key, at=at, outcome=outcome, state="opened", failures=0)
        return (fails, until), Row(k=key, at=at, outcome=outcome, state="closed", failures=fails)


class AlertStore(_Keyed):
    """Of alerts (code, at, seq, severity, message): a row for each code and batch: how often it was raised anew, first and last seen. One that isn't seen for a while is told once more, as resolved, and begins anew when it comes back."""

    STATE = _struct("severity string, message string, n bigint, first_seen bigint, last_seen bigint")
    ORDER = ("at", "seq")

    def __init__(self, seconds: int = RESOLVED_AFTER_S):
        self.seconds = seconds

    def begin(self) -> tuple:
        return (None, None, 0, None, None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else self.begin()
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            severity, message, n, first, _ = state
            state = (r["severity"], r["message"], n + ((severity, message) != (r["severity"], r["message"])), r["at"] if first is None else first, r["at"])
        self.state.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)
        yield self._row(key[0], state, "raised")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            state = tuple(self.state.get())
            self.state.clear()
            yield self._row(key[0], state, "resolved")

    @staticmethod
    def _row(code: str, state: tuple, what: str) -> Row:
        severity, message, n, first, last = state
        return Row(code=code, severity=severity, message=message, n=n, first_seen=first, last_seen=last, state=what)


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType, mode: str, time: str) -> DataFrame:
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode=mode, timeMode=time)


def throttled(rows: DataFrame, seconds: int) -> DataFrame:
    """Of a stream (k, at in seconds): the rows that pass."""
    return _with_state(rows.select("k", "at"), "k", Throttle(seconds), PASSED, "Append", "None")


def breaker(calls: DataFrame, after: int = BREAKER_AFTER, seconds: int = BREAKER_SECONDS) -> DataFrame:
    """Of a stream of calls (k, at in seconds, outcome): the breaker's state behind each."""
    return _with_state(calls.select("k", "at", "outcome"), "k", Breaker(after, seconds), CALLS, "Append", "None")


def alert_store(alerts: DataFrame, seconds: int = RESOLVED_AFTER_S) -> DataFrame:
    """Of a stream of alerts (code, at in seconds, seq, severity, message): each code's state after each batch that names it."""
    return _with_state(alerts.select("code", "at", "seq", "severity", "message"), "code", AlertStore(seconds), ALERTS, "Update", "ProcessingTime")


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"):
    """Start a query with the state store that these rules need. It works off what there is and ends; with timers, which would keep it going, after one batch."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if mode == "update" else writer.trigger(availableNow=True)).start()
