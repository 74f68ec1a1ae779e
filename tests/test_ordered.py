"""Ranks and sums over hot keys, in blocks far smaller than the keys, against windows that hold them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import mining, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    keys = ["hot"] * 8 + ["b", "c", None]
    return spark.createDataFrame([(rng.choice(keys), rng.randrange(200), i, rng.randrange(-5, 9)) for i in range(900)] + [("one", 5, 901, 3)], "k string, t int, id int, v int").repartition(7).cache()


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


ORDER = ["t", "id"]


def test_places(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    wanted = rows.withColumns({"_o_at": F.row_number().over(w) - 1, "_o_m": F.count(F.lit(1)).over(Window.partitionBy("k"))})
    same(ordered.numbered(rows, ORDER, "k").select(*rows.columns, F.col("_o_at").cast("int"), "_o_m"), wanted)
    assert [r["_o_at"] for r in ordered.numbered(rows, ORDER).orderBy(*ORDER).collect()] == list(range(901))


@pytest.mark.parametrize("block", [10, 37, 100_000])
def test_sums(rows, block):
    w = Window.partitionBy("k").orderBy("t", "id")
    sums = {"s": F.col("v"), "n": F.lit(1)}
    wanted = rows.withColumns({"s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w).cast("long")})
    same(ordered.running(rows, ORDER, "k", sums, block), wanted)
    wanted = rows.withColumns({"s": F.sum("v").over(w.rowsBetween(-9, 0)), "n": F.least(F.lit(10), F.row_number().over(w)).cast("long")})
    same(ordered.sliding(rows, ORDER, "k", 10, sums, block), wanted)


def test_edges(rows, tmp_path, spark):
    none = rows.where("id < 0")
    assert ordered.running(none, ORDER, "k", {"s": F.col("v")}).collect() == ordered.sliding(none, ORDER, "k", 3, {"s": F.col("v")}).collect() == []
    with pytest.raises(ValueError, match="block"):
        ordered.sliding(rows, ORDER, "k", 11, {"s": F.col("v")}, block=10)
    sample = mining.spread_sample(rows.select("id"), 10, "id")
    assert sorted(r["id"] for r in sample.collect()) == [90 * i for i in range(10)]
    lines = spark.createDataFrame([("foto, photo", 2), ("tesouro, thesouro", 9), ("a, b", 2)], "line string, hits bigint")
    mining.write_list(lines, "Variants", f"{tmp_path}/list")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/list").collect()] == ["# Variants (3)", "tesouro, thesouro", "a, b", "foto, photo"]
