"""The joins over keys of fingerprints, whose sizes Spark underrates: none is broadcast through the driver."""

from pyspark.sql import functions as F

from vitrine.llm import simhash


def test_no_key_join_is_broadcast(spark, monkeypatch):
    frames, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: frames.append(df) or write(df, name))
    # 300 fingerprints, and neighbours of one bit for a third of them; a bucket limit of 1 sends all through the stars, too
    one = spark.range(300).select(F.xxhash64("id").alias("fp"))
    other = spark.range(0, 300, 3).select(F.xxhash64("id").bitwiseXOR(F.lit(1)).alias("fp"))
    nodes = one.union(other).select("fp", F.col("fp").alias("rep"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    for limit in (simhash.MAX_BUCKET, 1):
        found = simhash.links(nodes, limit)
        assert [u ^ v for u, v in found.collect()] == [1] * 100
        frames.append(found)
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Broadcast" not in plan
