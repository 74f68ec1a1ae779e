"""Settings, versioned tables and the service over a folder."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators.service import Service
from vitrine.plans import settings as st
from vitrine.sources.catalogue import ITEM
from vitrine.sources.store import Store


@pytest.mark.parametrize(
    ("key", "value", "wanted"),
    [
        ("es_timeout", "99", 60), ("es_timeout", "x", 1), ("search_timeout", 0.44, 0.5), ("search_timeout", "2.26", 2.3), ("batch_size", 0, 1), ("facet_max_terms", 5000, 1000), ("log_retention_days", -3, 1),
        ("engine", "OpenSearch", "elasticsearch"), ("engine", "db", "sql"), ("es_url", "ftp://x", ""), ("es_url", " http://127.0.0.1:9200 ", "http://127.0.0.1:9200"), ("index_name", "A b/C-1", "abc-1"),
        ("analysis_language", "GERMAN", "german"), ("analysis_language", "klingon", "brazilian"), ("auto_check_frequency", "weekly", "hourly"), ("menu_location", "root", "root"), ("search_prefix", 0, False),
        ("es_username", "<b>me</b>", "me"), ("last_index_run_ts", -5, 0),
    ],
)
def test_coerce(key, value, wanted):
    got = st.coerce(key, value)
    assert got == wanted and type(got) is type(wanted)


def test_settings():
    s = st.update({}, {"es_password": "p", "nonsense": 1, "index_name": "!"}, "http://home")
    assert "nonsense" not in s and s["index_name"] == st.default_index_name("http://home")
    assert st.masked(s)["es_password"] == "__set__" and st.masked(s)["es_api_key"] == ""
    assert st.update(s, {"es_password": "__set__"})["es_password"] == "p"
    assert st.inline_credentials("http://elastic:E@T%40@host:9200/x") == ("http://host:9200/x", "elastic", "E@T@")
    assert st.inline_credentials("http://host") == ("http://host", "", "")
    assert st.auth({"es_api_key": "k", "es_username": "u"})[0] == "api_key"
    assert st.auth({"es_username": "u", "es_url": "http://a:b@h"})[:2] == ("basic_auth", "u")
    assert st.auth({"es_url": "http://a:b@h"}) == ("basic_auth_inline", "a", "Basic YTpi")
    assert st.auth({}) == ("none", "", "")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "item_id bigint, title string")
    assert not s.exists("t") and s.stats("t")["rows"] == 0 and s.drop("t") is False
    assert s.create("t", row(1).schema) and not s.create("t", row(1).schema)
    bad = s.bulk("t", row(1, 2, 3), check=F.when(F.col("item_id") == 2, "no"))
    assert [tuple(r) for r in bad.collect()] == [(2, "no")] and s.stats("t")["rows"] == 2
    again = s.bulk("t", row(4, 6), check=F.lit("no"))  # every refused row comes back, and an earlier result stays as it was
    assert sorted(r["item_id"] for r in again.collect()) == [4, 6] and s.stats("t")["rows"] == 2
    (tmp_path / "t" / "v99").mkdir()  # a version that was never finished
    assert s.read("t").count() == 2
    s.remove("t", row(1, 7))
    s.append("t", row(5))
    assert sorted(r["item_id"] for r in s.read("t").collect()) == [3, 5] and len(s.versions("t")) <= 3
    s.recreate("t", row(1).schema)
    assert s.read("t").count() == 0
    with pytest.raises(FileNotFoundError):
        s.read("nothing")


def test_service(spark, tmp_path):
    rows = [(i, "col_a" if i < 8 else "col_b", "publish" if i % 5 else "draft", f"Quadro {i}", None, "pintura antiga" if i % 2 else "tela", None, None, None) for i in range(1, 11)]
    now = [1000.0]
    source = [spark.createDataFrame(rows, ITEM)]
    s = Service(spark, str(tmp_path), lambda: source[0], lambda: now[0])
    assert s.process_batch()["skipped"] == "not_configured" and s.status() == "red"
    with pytest.raises(RuntimeError):
        s.reindex_all()
    assert s.create_index() and s.health()["reason"] == "divergence"
    s.set_settings({"batch_size": 6, "max_retries": 1})
    assert s.reindex_collection("col_b") == 3 and s.reindex_all() == 10
    s.pause()
    assert s.process_batch()["state"] == "paused" and s.status() == "yellow"
    s.resume()
    odd = F.when(F.col("item_id") == 3, "mapper_parsing")
    r = s.process_batch(odd)
    assert (r["processed"], r["failed"], r["remaining"]) == (5, 1, 5)
    now[0] += 10
    r = s.process_batch(odd)
    assert (r["processed"], r["failed"], r["dropped"], r["remaining"]) == (4, 1, 1, 0)
    assert s.process_batch()["state"] == "finished" and s.state()["failures"] == 1
    assert s.enqueue_missing() == 1 and s.process_batch()["processed"] == 1
    assert s.metrics().first()["indexed"] == 10 and s.index_stats()["rows"] == 10
    source[0] = source[0].where("item_id > 2")
    assert s.purge_orphans() == 2 and s.purge_orphans() == 0
    assert s.health()["reason"] == "divergence" and s.health(refresh=True)["reason"] == "ok"
    assert [c["coverage_pct"] for c in s.collections()] == [100.0, 100.0]
    assert s.logs(level="error").count() == 2
    s.purge_logs()
    assert s.logs().count() == 2
    s.save_vocabulary({"synonyms": "pintura, tela"})
    assert s.vocabulary_pending() and "vocabulary" in [f["code"] for f in s.diagnostics().collect()]
    assert all(f["title"] and f["action"] for f in s.diagnostics().collect() if f["code"] != "ok")
    assert s.validate_vocabulary({"corrections": "a"}).first()["errors"] == 1
    assert s.apply_vocabulary() == 1 and not s.vocabulary_pending()
    t = s.test_vocabulary("pintura")
    assert t["forms"] == ["pintura", "tela"] and t["with"] > t["without"]
    assert s.evaluate_alerts().count() == 0 and s.test_connection()["auth"] == "none"
    s.cancel()
    s.clear_logs()
    s.reset_metrics()
    s.clear_alerts()
    assert s.state()["state"] == "idle" and s.delete_index()


def test_health_is_measured(spark, tmp_path, monkeypatch):
    rows = [(i, "col_a", "publish", f"Quadro {i}", None, "tela", None, None, None) for i in range(1, 4)]
    s = Service(spark, str(tmp_path), lambda: spark.createDataFrame(rows, ITEM))
    assert not s.probe()["index"] and s.snapshot().first()["index_status"] is None
    s.create_index()
    first = s.snapshot().first()
    assert first["reachable"] and first["index_status"] == "green" and first["error"] == "" and first["ping_ms"] >= 0

    def broken():
        raise OSError("the disk is gone")

    monkeypatch.setattr(s.index, "read", broken)
    now = s.snapshot().first()
    assert not now["reachable"] and now["cluster_status"] == "red" and "gone" in now["error"]


def test_breaker_lock_and_full_queue(spark, tmp_path, monkeypatch):
    """Three failures in a row open the breaker; a held lock keeps others out; a full queue says so; errors of every kind are logged."""
    from vitrine.operators import queue
    from vitrine.sources.keyed import locked

    rows = [(i, "col_a", "publish", f"Quadro {i}", None, "tela", None, None, None) for i in range(1, 81)]
    now = [1000.0]
    s = Service(spark, str(tmp_path), lambda: spark.createDataFrame(rows, ITEM), lambda: now[0])
    s.create_index()
    s.set_settings({"batch_size": 100, "max_retries": 0})
    s.reindex_all()
    with locked(s.store, "process", 600, now[0]):
        assert s.process_batch()["skipped"] == "locked"
    merge = s.index.merge
    monkeypatch.setattr(s.index, "merge", lambda *a, **k: (_ for _ in ()).throw(OSError("no space")))
    for n in range(3):
        assert s.process_batch() == {"ok": False, "processed": 0, "remaining": 80}
        assert s.process_batch()["skipped"] == "backoff"
        if n < 2:
            now[0] += 301
    assert s._get("state")["breaker_until"] == now[0] + queue.BREAKER_SECONDS and s._get("state")["breaker_fails"] == 0
    s._set_state("running", backoff_until=0)
    assert s.process_batch()["skipped"] == "breaker"
    now[0] += queue.BREAKER_SECONDS
    monkeypatch.setattr(s.index, "merge", merge)
    r = s.process_batch(F.when(F.col("item_id") > 20, F.concat(F.lit("kind "), F.col("item_id").cast("string"))))
    assert (r["processed"], r["failed"], r["dropped"]) == (20, 60, 60)
    assert s.logs(level="error", per_page=500).count() == 3 + 60 and s.export_logs(level="error", per_page=500).count() == 63
    assert len({x["id"] for x in s.store.read("logs").collect()}) == 63
    monkeypatch.setattr(queue, "CAP", 5)
    s.cancel()
    assert s.enqueue(spark.range(1, 8).withColumnRenamed("id", "item_id")) == 7 and s.enqueue(spark.range(20, 23).withColumnRenamed("id", "item_id")) == 7
    assert s.logs(level="warning").first()["message"] == "queue full, nothing enqueued"


def test_vocabulary_in_two_phases(spark, tmp_path, monkeypatch):
    """An application that dies at any step, or rehearses badly, leaves the old rules with their own mark."""
    s = Service(spark, str(tmp_path), lambda: spark.createDataFrame([], ITEM), lambda: 1000.0)
    assert s.rules() == []
    s.save_vocabulary({"synonyms": "pintura, tela\ngravura -> estampa", "stopwords": "rio"})
    assert s.apply_vocabulary() == 2 and not s.vocabulary_pending()
    old, applied = s.rules(), s._get("applied")
    assert (["pintura", "tela"], []) in old and (["gravura"], ["estampa"]) in old and applied["stopwords"] == ["rio"]
    assert [x["step"] for x in applied["steps"]] == ["compiled", "staged", "rehearsed"]
    assert {"text": "gravura", "forms": ["estampa"]} in applied["steps"][2]["samples"]
    s.save_vocabulary({"synonyms": "foto, fotografia"})
    dies = lambda *a, **k: (_ for _ in ()).throw(OSError("gone"))
    for name in ("_read_back", "rehearse", "_put"):
        with monkeypatch.context() as m:
            m.setattr(s, name, dies)
            with pytest.raises(OSError, match="gone"):
                s.apply_vocabulary()
        assert s.rules() == old and s._get("applied") == applied and s.vocabulary_pending()
    with monkeypatch.context() as m:
        m.setattr(s, "_read_back", lambda staged: s.store.read(staged).limit(0))
        with pytest.raises(RuntimeError, match="staged"):
            s.apply_vocabulary()
    with pytest.raises(RuntimeError, match="becomes"):
        s.rehearse([(["c#", "d#"], [])])  # terms that were not normalised
    assert s.apply_vocabulary() == 1 and s.rules() == [(["foto", "fotografia"], [])] and not s.vocabulary_pending()
    s.save_vocabulary({"corrections": "a"})
    with pytest.raises(ValueError, match="arrow required"):
        s.apply_vocabulary()
    assert s.rules() == [(["foto", "fotografia"], [])]


def test_ticks(spark, tmp_path):
    """Health and indexing once a minute, cleaning once a day, indexing only while something waits and it is turned on."""
    rows = [(i, "col_a", "publish", "t", None, None, None, None, None) for i in range(1, 4)]
    now = [100_000.0]
    s = Service(spark, str(tmp_path), lambda: spark.createDataFrame(rows, ITEM), lambda: now[0])
    s.create_index()
    s.set_settings({"auto_indexing_enabled": True})
    assert s.tick() == ["health", "cleanup"] and s.tick() == []
    s.reindex_all()
    assert s.tick() == ["index"] and s.index_stats()["rows"] == 3
    now[0] += 61
    assert s.tick() == ["health"]
    s.set_settings({"auto_indexing_enabled": False})
    s.reindex_all()
    now[0] += 86_400
    assert s.tick() == ["health", "cleanup"] and s.queue_size() == 3
