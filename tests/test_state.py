"""State of a stream, over several batches and restarts, against the batch rules over all rows."""

import random

import pytest

from vitrine.operators import monitor, queue
from vitrine.streaming import state


def batches(spark, tmp_path, schema, parts, make, mode="append"):
    """What a stream gives over parts that come one after the other, each in a run of its own from the same checkpoint."""
    feed, out = f"{tmp_path}/feed", []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = make(spark.readStream.schema(schema).parquet(feed))
        state.run(stream, f"{tmp_path}/check", lambda df, n: out.append(sorted(map(tuple, df.collect()), key=str)), mode).awaitTermination(60)
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def parts(rng, make, n=3, each=60):
    """Rows of a few keys in order of time from part to part, in any order within one."""
    out, t = [], 0
    for _ in range(n):
        rows = []
        for _ in range(each):
            t += rng.randrange(30)
            rows.append(make(f"k{rng.randrange(4)}", t, len(rows) + 1000 * len(out)))
        rng.shuffle(rows)
        out.append(rows)
    return out


def test_throttle(spark, tmp_path):
    some = parts(random.Random(1), lambda k, t, i: (k, t))
    found = batches(spark, tmp_path, "k string, at long", some, lambda s: state.throttled(s, 100))
    wanted = queue.throttle(spark.createDataFrame(sum(some, []), "k string, at long"), 100)
    assert sorted(sum(found, [])) == sorted(map(tuple, wanted.collect()))


def test_breaker(spark, tmp_path):
    rng = random.Random(2)
    schema = "k string, at long, outcome string"
    some = parts(rng, lambda k, t, i: (k, t, rng.choice(["ok", "fail", "fail", "fail", "ignored"])))
    found = batches(spark, tmp_path, schema, some, state.breaker)
    wanted = queue.breaker(spark.createDataFrame(sum(some, []), schema))
    assert sorted(sum(found, [])) == sorted(map(tuple, wanted.collect()))
    assert {"opened", "refused", "closed"} <= {r[3] for r in sum(found, [])}


def test_alert_store(spark, tmp_path):
    rng = random.Random(3)
    schema = "code string, at long, seq long, severity string, message string"
    some = parts(rng, lambda k, t, i: (k, t, i, rng.choice(["warning", "critical"]), "m"))
    found = batches(spark, tmp_path, schema, some, state.alert_store, "update")
    last = {}
    for batch in found:
        last |= {r[0]: r for r in batch}
    wanted = monitor.alert_store(spark.createDataFrame(sum(some, []), schema)).select("code", "severity", "message", "n", "first_seen", "last_seen")
    assert sorted(r[:6] for r in last.values()) == sorted(map(tuple, wanted.collect())) and {r[6] for r in last.values()} == {"raised"}


def test_alerts_resolve(spark, tmp_path):
    """An alert that isn't seen for its time is told as resolved, and begins anew."""
    schema = "code string, at long, seq long, severity string, message string"
    some = [[("a", 1, 1, "warning", "m")], [("b", 2, 2, "warning", "m")], [("a", 9, 3, "warning", "m")]]
    found = sum(batches(spark, tmp_path, schema, some, lambda s: state.alert_store(s, 0), "update"), [])
    assert ("a", "warning", "m", 1, 1, 1, "resolved") in found and ("a", "warning", "m", 1, 9, 9, "raised") in found
