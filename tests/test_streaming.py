"""The stream of changes ends in the table that the batch rules give; batches rewrite the buckets that they touch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.sources.catalogue import _struct
from vitrine.sources.keyed import Busy, KeyedTable, locked
from vitrine.sources.store import Store
from vitrine.streaming import ingest

TITLED = _struct("item_id bigint, title string")
DOCUMENT = T.StructType([*TITLED.fields, T.StructField("references", T.ArrayType(T.LongType()))])


def at(minute):
    return dt.datetime(2024, 1, 1, minute // 60, minute % 60)


def test_stream(spark, tmp_path):
    feed, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    put = lambda rows: spark.createDataFrame(rows, ingest.CHANGE).coalesce(1).write.mode("append").parquet(feed)
    build = lambda df: df.withColumn("title", F.concat(F.lit("t"), F.col("item_id").cast("string")))
    put([(1, "col_a", "save", at(0)), (2, "col_a", "save", at(0)), (1, "col_a", "save", at(0)), (3, "page", "save", at(0))])
    run = lambda: ingest.run(ingest.changes(spark, feed), out, check, build, TITLED, once=True).awaitTermination(120)
    run()
    assert sorted(r["item_id"] for r in ingest.current(spark, out, TITLED).collect()) == [1, 2]
    put([(2, "col_a", "delete", at(30)), (4, "col_a", "save", at(30))])
    run()
    assert {r["item_id"]: r["title"] for r in ingest.current(spark, out, TITLED).collect()} == {1: "t1", 4: "t4"}


def test_referrers_in_the_stream(spark, tmp_path):
    """Documents hold the titles of those they refer to; a rename reaches all of them, also those that began or ceased to refer in between."""
    feed, out, check, names, links = *(str(tmp_path / x) for x in ("feed", "out", "check")), {}, {}

    def build(ids):
        wanted = [r["item_id"] for r in ids.collect()]
        rows = [(i, f"{names[i]}:" + ",".join(names[t] for t in links.get(i, [])), links.get(i, [])) for i in wanted if i in names]
        return spark.createDataFrame(rows, DOCUMENT)

    def change(*rows):
        spark.createDataFrame(rows, ingest.CHANGE).coalesce(1).write.mode("append").parquet(feed)
        ingest.run(ingest.changes(spark, feed), out, check, build, DOCUMENT, once=True, buckets=8).awaitTermination(120)
        return {r["item_id"]: r["title"] for r in ingest.current(spark, out, DOCUMENT, 8).collect()}

    names.update({i: f"n{i}" for i in range(60)})
    links.update({i: [0] for i in range(1, 50)} | {50: [1]})
    found = change(*[(i, "col_a", "save", at(0)) for i in range(60)])
    assert found[7] == "n7:n0" and len(found) == 60
    names[0] = "new"
    assert change((0, "col_a", "rename", at(1)))[49] == "n49:new"  # no cap on referrers
    links[7] = [50]
    assert change((7, "col_a", "save", at(2)))[7] == "n7:n50"
    names[0], names[50] = "newer", "fifty"
    found = change((0, "col_a", "rename", at(3)), (50, "col_a", "rename", at(3)))
    assert found[7] == "n7:fifty" and found[8] == "n8:newer" and found[50] == "fifty:n1"
    del names[0]
    names[0] = "(gone)"
    found = change((0, "col_a", "delete", at(4)))
    assert 0 not in found and found[8] == "n8:(gone)" and len(found) == 59
    refers = ingest.tables(spark, out, DOCUMENT, 8)[1]
    assert {tuple(r) for r in refers.read().collect()} == {(t, i) for i, some in links.items() for t in some}
    assert refers.lookup(spark.createDataFrame([(0,)], "target_id long")).count() == 48


def test_referrers_and_windows(spark):
    rows = spark.createDataFrame([(9, "col_a", "rename", dt.datetime(2024, 1, 1)), (8, "col_a", "save", dt.datetime(2024, 1, 1))], ingest.CHANGE)
    refs = spark.createDataFrame([(1, 9), (2, 8), (9, 9), (8, 9)], "item_id long, target_id long")
    assert sorted((r["item_id"], r["action"]) for r in ingest.with_referrers(rows, refs).collect()) == [(1, "save"), (8, "save"), (9, "rename")]
    assert ingest.edit_sessions(rows).count() == 2


def test_buckets(spark, tmp_path):
    """Against a plain dictionary, batch after batch; files only of touched buckets are new."""
    table, rng, wanted = KeyedTable(Store(spark, str(tmp_path)), "t", TITLED, buckets=16), random.Random(1), {}
    rows = lambda some: spark.createDataFrame(sorted(some.items()), TITLED)
    assert not table.exists() and table.read().count() == 0 and table.create() and not table.create()
    first = {i: f"a{i}" for i in range(400)}
    assert table.merge(rows(first)) == 16
    wanted |= first
    for n in range(5):
        some = {rng.randrange(500): f"b{n}" for _ in range(2)}
        gone = [k for k in rng.sample(sorted(wanted), 1) if k not in some]
        before = table.places()
        touched = table.merge(rows(some), spark.createDataFrame([(k,) for k in gone], "item_id long"))
        wanted = {k: v for k, v in wanted.items() if k not in gone} | some
        assert {tuple(r) for r in table.read().collect()} == set(wanted.items())
        assert touched <= len(some) + len(gone) and sum(table.places().get(b) != p for b, p in before.items()) <= touched
    assert table.merge() == 0 and table.merge(rows({1: "x"})) == table.merge(rows({1: "x"})) == 1
    assert table.stats()["rows"] == len(wanted | {1: "x"}) and table.stats()["files"] <= 2 * 16
    assert len(list((tmp_path / "t_data").iterdir())) < 9  # what nothing names any more is gone
    (tmp_path / "t_data" / "dead" / "bucket=3").mkdir(parents=True)  # a batch that died
    assert table.read().count() == len(wanted | {1: "x"}) and table.lookup(spark.createDataFrame([(1,), (9999,)], "item_id long")).collect() == [(1, "x")]
    assert table.compact(3) == 3 and {tuple(r) for r in table.read().collect()} == set((wanted | {1: "x"}).items())
    assert not (tmp_path / "t_data" / "dead").exists() and table.drop() and not table.exists() and not table.drop()


def test_a_batch_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(Store(spark, str(tmp_path)), "t", TITLED, buckets=4)
    table.merge(spark.createDataFrame([(i, "a") for i in range(20)], TITLED))
    monkeypatch.setattr(table, "_publish", lambda places: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        table.merge(spark.createDataFrame([(i, "b") for i in range(20)], TITLED))
    again = KeyedTable(Store(spark, str(tmp_path)), "t", TITLED, buckets=4)
    assert {r["title"] for r in again.read().collect()} == {"a"}
    again.merge(spark.createDataFrame([(i, "b") for i in range(20)], TITLED))
    assert {r["title"] for r in again.read().collect()} == {"b"}


def test_one_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with locked(store, "t", 60, 1000.0):
        with pytest.raises(Busy), locked(store, "t", 60, 1030.0):
            pass
        with locked(store, "t", 60, 1090.0):  # left by a writer that died
            pass
    with locked(store, "t", 60, 1001.0):
        pass
