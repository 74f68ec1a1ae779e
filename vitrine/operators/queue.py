"""The index queue: de-duplicated enqueueing, first-in batches, retries and drops, breaker and throttles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 500_000
MAX_RETRIES = 3
BREAKER_AFTER, BREAKER_SECONDS = 3, 120


def enqueue(queue: DataFrame, incoming: DataFrame, cap: int = CAP) -> DataFrame:
    """The queue (item_id, enqueued_at) with new positive ids; a queued id keeps its time. A full queue takes nothing."""
    if queue.limit(cap).count() >= cap:
        return queue
    first = incoming.where("item_id > 0").groupBy("item_id").agg(F.min("enqueued_at").alias("enqueued_at"))
    return queue.unionByName(first.join(queue.select("item_id"), "item_id", "left_anti"))


def next_batch(queue: DataFrame, size: int) -> DataFrame:
    return queue.orderBy("enqueued_at", "item_id").limit(size).select("item_id")


def retry_or_drop(outcomes: DataFrame, max_retries: int = MAX_RETRIES, reset_on_success: bool = False) -> DataFrame:
    """Outcomes (item_id, at, ok) in order of time: with each failure's number and whether it is queued again or dropped.

    An item's failures are counted over its whole life; reset_on_success starts anew behind each success.
    """
    keys = ["item_id"]
    if reset_on_success:
        w = Window.partitionBy("item_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        outcomes = outcomes.withColumn("life", F.coalesce(F.sum(F.col("ok").cast("int")).over(w), F.lit(0)))
        keys.append("life")
    count = F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    verdict = F.when(F.col("ok"), "done").when(F.col("failures") <= max_retries, "retry").otherwise("drop")
    return outcomes.withColumn("failures", count).withColumn("verdict", verdict)


def error_summary(errors: DataFrame) -> DataFrame:
    """Of (type, ord, reason, item_id): count, first reason and first item of each type."""
    return errors.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", "ord").alias("sample_reason"), F.min_by("item_id", "ord").alias("sample_id"))


def streaks(calls: DataFrame, key: str = "k") -> DataFrame:
    """Of calls (k, at, ok): the length of the run of failures that each failed call stands in so far."""
    w = Window.partitionBy(key).orderBy("at")
    island = calls.withColumn("island", F.sum(F.col("ok").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where(~F.col("ok")).withColumn("streak", F.row_number().over(Window.partitionBy(key, "island").orderBy("at")).cast("long")).drop("island")


def _scan(df: DataFrame, columns: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of each key k in order of time through ``step(state, *row) -> (state, output row or None)``.

    Keys are dealt out whole and streamed in order, so what is held is a key's state, never its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for b in batches:
            rows = []
            for row in b[columns].itertuples(index=False, name=None):
                if state is None or row[0] != key:
                    key, state = row[0], start()
                state, out = step(state, *row)
                if out is not None:
                    rows.append(out)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return df.select(*columns).repartition("k").sortWithinPartitions(*columns).mapInPandas(run, schema)


def breaker(calls: DataFrame, after: int = BREAKER_AFTER, seconds: int = BREAKER_SECONDS) -> DataFrame:
    """Of calls (k, at in seconds, outcome ok/fail/ignored): the breaker's state after each.

    So many failures in a row open it for some seconds and its counter starts anew; calls that come while it is
    open are refused and change nothing; ignored outcomes neither count nor reset.
    """

    def step(state: tuple[int, int], k: str, at: int, outcome: str):
        fails, until = state
        if at < until:
            return state, (k, at, outcome, "refused", fails)
        fails = 0 if outcome == "ok" else fails + (outcome == "fail")
        if fails >= after:
            return (0, at + seconds), (k, at, outcome, "opened", 0)
        return (fails, until), (k, at, outcome, "closed", fails)

    return _scan(calls, ["k", "at", "outcome"], lambda: (0, 0), step, "k string, at long, outcome string, state string, failures long")


def throttle(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows (k, at) that pass at most once in so many seconds by key."""

    def step(last: int, k: str, at: int):
        return (at, (k, at)) if at - last >= seconds else (last, None)

    return _scan(rows, ["k", "at"], lambda: -(1 << 62), step, "k string, at long")
