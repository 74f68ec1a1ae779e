"""The engine as a service over a folder: settings, index, queue, runs, logs, alerts, vocabulary.

Each public method is one call of the management surface and returns a DataFrame or a dict. State lives in
versioned tables; a call that dies leaves the last finished version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions.text import scrub
from vitrine.operators import ingest, monitor, queue, vocabulary
from vitrine.operators.textindex import Options, TextIndex
from vitrine.plans import settings as st
from vitrine.sources.catalogue import ITEM, RUN, Catalogue, _struct
from vitrine.sources.files import log_page, retained
from vitrine.sources.keyed import Busy, KeyedTable, locked
from vitrine.sources.store import Store

QUEUE = _struct("item_id bigint, enqueued_at bigint")
FAILURES = _struct("item_id bigint, n bigint")
PAIRS = _struct("key string, value string")
LOG = _struct("id bigint, created_at timestamp, level string, channel string, message string, context string")
ALERT = _struct("code string, at bigint, seq bigint, severity string, message string")
RULES = _struct("list string, line int, rule string, note string")
BACKOFF_S = 300
#: Seconds between two runs of what a scheduler does.
TICKS = {"health": 60, "index": 60, "cleanup": 86400}
REHEARSED = 4  # rules
LOCK_S = 600  # after which a batch's lock was left by a writer that died
CACHE_S = {"health": 60, "collections": 300}


class Service:
    def __init__(self, spark: SparkSession, folder: str, source: Callable[[], DataFrame], clock: Callable[[], float] = time.time):
        self.spark, self.store, self.source, self.clock = spark, Store(spark, folder), source, clock
        self.index = KeyedTable(self.store, "index", ITEM)
        self._memo: dict[str, tuple[float, object]] = {}

    # ------------------------------------------------ small state

    def _get(self, name: str) -> dict:
        return {r["key"]: json.loads(r["value"]) for r in self.store.read(name, PAIRS).collect()}

    def _put(self, name: str, values: dict) -> None:
        self.store.write(name, self.spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], PAIRS).coalesce(1))

    def cached(self, name: str, make: Callable[[], object], refresh: bool = False) -> object:
        """A result that is made anew after its time to live."""
        now = self.clock()
        if refresh or name not in self._memo or now - self._memo[name][0] >= CACHE_S[name]:
            self._memo[name] = (now, make())
        return self._memo[name][1]

    # ------------------------------------------------ settings

    def settings(self) -> dict:
        return dict(st.DEFAULTS) | self._get("settings")

    def get_settings(self) -> dict:
        return st.masked(self.settings())

    def set_settings(self, changes: dict) -> dict:
        self._put("settings", st.update(self.settings(), changes, self.store.folder))
        return self.get_settings()

    def test_connection(self) -> dict:
        """Whether the folder answers, and what would be used to sign in."""
        found = self.probe()
        method, user, _ = st.auth(self.settings())
        return {"ok": found["reachable"], "ms": found["ping_ms"], "error": found["error"], "auth": method, "user": user, "url": st.inline_credentials(self.settings()["es_url"])[0]}

    # ------------------------------------------------ index and queue

    def create_index(self) -> bool:
        return self.index.create()

    def delete_index(self) -> bool:
        return self.index.drop()

    def recreate_index(self) -> None:
        self.index.drop()
        self.index.create()

    def index_stats(self) -> dict:
        return self.index.stats()

    def enqueue(self, ids: DataFrame) -> int:
        """The queue's size with the ids in it; a full queue takes none of them and says so in the log."""
        before = self.store.read("queue", QUEUE)
        if before.count() >= queue.CAP:
            self.log("warning", "indexer", "queue full, nothing enqueued", {"cap": queue.CAP, "refused": ids.join(before, "item_id", "left_anti").count()})
            return self.queue_size()
        self.store.write("queue", queue.enqueue(before, ids.select("item_id", F.lit(int(self.clock())).cast("long").alias("enqueued_at"))))
        return self.queue_size()

    def queue_size(self) -> int:
        return self.store.read("queue", QUEUE).count()

    def reindex_all(self) -> int:
        if not self.index.exists():
            raise RuntimeError("no index")
        return self.enqueue(self._live().select("item_id"))

    def reindex_collection(self, post_type: str) -> int:
        return self.enqueue(self._live().where(F.col("post_type") == post_type).select("item_id"))

    def enqueue_missing(self) -> int:
        return self.enqueue(ingest.missing(self._live(), self.index.read()))

    def purge_orphans(self) -> int:
        gone = ingest.orphans(self.index.read(), self.source())
        n = gone.count()
        if n:
            self.index.merge(gone=gone)
        return n

    def _live(self) -> DataFrame:
        return self.source().where(F.col("post_status").isin("publish", "private", "draft"))

    def state(self) -> dict:
        s = self._get("state")
        return {"state": s.get("state", "idle"), "queue": self.queue_size(), "failures": self.store.read("failures", FAILURES).where("n > 0").count()}

    def _set_state(self, state: str, **more) -> None:
        self._put("state", self._get("state") | {"state": state} | more)

    def pause(self) -> None:
        self._set_state("paused")

    def resume(self) -> None:
        self._set_state("running" if self.queue_size() else "idle")

    def cancel(self) -> None:
        self.store.write("queue", self.spark.createDataFrame([], QUEUE))
        self._set_state("idle", backoff_until=0)

    def process_batch(self, check: Column | None = None) -> dict:
        """Build and write the head of the queue, one writer at a time. Rows that a check refuses are queued again, at the back, up to the retries of their life."""
        s = self._get("state")
        if s.get("state") == "paused":
            return {"ok": True, "processed": 0, "state": "paused"}
        if not self.index.exists():
            return {"ok": False, "processed": 0, "skipped": "not_configured"}
        for name in ("backoff", "breaker"):
            if s.get(f"{name}_until", 0) > self.clock():
                return {"ok": False, "processed": 0, "skipped": name}
        if not self.queue_size():
            self._set_state("finished")
            return {"ok": True, "processed": 0, "state": "finished"}
        try:
            with locked(self.store, "process", LOCK_S, self.clock()):
                return self._process(check)
        except Busy:
            return {"ok": False, "processed": 0, "skipped": "locked"}

    def _process(self, check: Column | None) -> dict:
        waiting = self.store.read("queue", QUEUE)
        before = waiting.count()
        if not before:
            self._set_state("finished")
            return {"ok": True, "processed": 0, "state": "finished"}
        began = self.clock()
        batch = queue.next_batch(waiting, self.settings()["batch_size"]).persist()
        docs = self._live().join(batch, "item_id", "left_semi").persist()
        built = docs.count()
        try:
            bad = self._bulk(docs, check)
        except Exception as e:  # the sink as a whole: the queue stays as it is
            # so many failures in a row open the breaker, and its counter starts anew
            fails = self._get("state").get("breaker_fails", 0) + 1
            opened = fails >= queue.BREAKER_AFTER
            breaker = {"breaker_fails": 0, "breaker_until": self.clock() + queue.BREAKER_SECONDS} if opened else {"breaker_fails": fails}
            self._set_state("running", backoff_until=self.clock() + BACKOFF_S, fallback_at=self.clock(), **breaker)
            self.log("error", "indexer", "bulk write failed", {"error": str(e)[:500], "breaker": "open" if opened else "closed"})
            return {"ok": False, "processed": 0, "remaining": before}
        taken = batch.count()
        old = self.store.read("failures", FAILURES)
        counted = old.unionByName(bad.select("item_id", F.lit(1).cast("long").alias("n"))).groupBy("item_id").agg(F.sum("n").alias("n"))
        self.store.write("failures", counted)
        again = self.store.read("failures").join(bad, "item_id", "left_semi")
        limit = self.settings()["max_retries"]
        retry = again.where(F.col("n") <= limit).select("item_id", F.lit(int(self.clock())).cast("long").alias("enqueued_at"))
        self.store.write("queue", waiting.join(batch, "item_id", "left_anti").unionByName(retry))
        failed, dropped, after = bad.count(), again.where(F.col("n") > limit).count(), self.queue_size()
        run = (int(began), int(1000 * (self.clock() - began)), built, built - failed, failed, taken - built, dropped, before, after)
        self.store.append("runs", self.spark.createDataFrame([run], RUN))
        if failed:  # a log row for each kind of error
            kinds = queue.error_summary(bad.select(F.col("reason").alias("type"), F.col("item_id").alias("ord"), "reason", "item_id"))
            self._log_rows(kinds.select(F.lit("error").alias("level"), F.lit("indexer").alias("channel"), F.lit("rows refused").alias("message"), F.to_json(F.struct("*")).alias("context")))
        self._set_state("running" if after else "finished", breaker_fails=0)
        batch.unpersist()
        docs.unpersist()
        return {"ok": True, "processed": built - failed, "failed": failed, "skipped": taken - built, "dropped": dropped, "remaining": after}

    def _bulk(self, rows: DataFrame, check: Column | None) -> DataFrame:
        """Put the rows that a check lets pass into the index; the others with their reason, as a table of its own."""
        judged = rows.withColumn("reason", F.lit(None).cast("string") if check is None else check).persist()
        self.index.merge(judged.where("reason IS NULL").drop("reason"))
        self.store.write("index_refused", judged.where("reason IS NOT NULL").select(F.col("item_id").cast("bigint"), "reason"))
        judged.unpersist()
        return self.store.read("index_refused")

    def tick(self) -> list[str]:
        """Do what is due, as a scheduler that calls every so often would have it; what was done."""
        due = self._get("ticks")
        done = []
        for name, seconds in TICKS.items():
            if self.clock() - due.get(name, 0) < seconds:
                continue
            if name == "health":
                self.evaluate_alerts()
            elif name == "cleanup":
                self.purge_logs()
            elif not self.settings()["auto_indexing_enabled"] or not self.queue_size():
                continue
            else:
                self.process_batch()
            due[name] = self.clock()
            done.append(name)
        if done:
            self._put("ticks", due)
        return done

    # ------------------------------------------------ logs, alerts, reports

    def log(self, level: str, channel: str, message: str, context: dict | None = None) -> None:
        row = (level, channel, message, json.dumps(scrub(context or {})))
        self._log_rows(self.spark.createDataFrame([row], "level string, channel string, message string, context string"))

    def _log_rows(self, rows: DataFrame) -> None:
        """Append rows of (level, channel, message, context), numbered on from the last; few at a time."""
        last = self.store.read("logs", LOG).agg(F.max("id")).first()[0] or 0
        number = F.row_number().over(Window.orderBy("context")) + F.lit(last).cast("long")
        made = rows.withColumns({"id": number, "created_at": F.timestamp_seconds(F.lit(int(self.clock()))), "message": F.regexp_replace("message", "<[^>]*>", "")})
        self.store.append("logs", made.select(*[f.name for f in LOG]))

    def export_logs(self, **options) -> DataFrame:
        """The page as JSON lines, as a download has them."""
        return self.logs(**options).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))

    def logs(self, **options) -> DataFrame:
        return log_page(self.store.read("logs", LOG), **options)

    def clear_logs(self) -> None:
        self.store.write("logs", self.spark.createDataFrame([], LOG))

    def purge_logs(self) -> None:
        now = self.spark.sql(f"SELECT timestamp_seconds({int(self.clock())}) AS t").first()["t"]
        self.store.write("logs", retained(self.store.read("logs", LOG), now, self.settings()["log_retention_days"]))

    def metrics(self) -> DataFrame:
        runs = self.store.read("runs", RUN).withColumn("run_id", F.monotonically_increasing_id())
        return monitor.kpis(runs, self.queue_size())

    def reset_metrics(self) -> None:
        self.store.write("runs", self.spark.createDataFrame([], RUN))

    def collections(self, refresh: bool = False) -> list:
        make = lambda: monitor.coverage(self._live(), self.index.read(), "post_type", self.settings()["divergence_threshold_pct"]).orderBy("post_type").collect()
        return self.cached("collections", make, refresh)  # type: ignore[return-value]

    def probe(self) -> dict:
        """What the index answers now: whether it can be read, how long that takes, its rows; yellow while refused rows wait for another try, red where it can't be read."""
        out = {"reachable": True, "index": False, "docs": 0, "status": None, "error": "", "nodes": self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()}
        began = time.perf_counter()
        try:
            out["index"] = self.index.exists()
            out["ping_ms"] = int(1000 * (time.perf_counter() - began))
            if out["index"]:
                out["docs"] = self.index.read().count()
                waiting = self.store.read("failures", FAILURES).join(self.store.read("queue", QUEUE), "item_id", "left_semi")
                out["status"] = "yellow" if waiting.take(1) else "green"
        except Exception as e:  # whatever the storage raises is what there is to report
            out |= {"reachable": False, "status": "red", "error": str(e)[:500], "ping_ms": int(1000 * (time.perf_counter() - began))}
        return out

    def snapshot(self) -> DataFrame:
        """The facts that health, alerts, diagnosis and light are told from."""
        s, state, probe = self.settings(), self.state(), self.probe()
        index, docs, source = probe["index"], probe["docs"], self._live().count()
        gap = max(0.0, round(100 - 100 * docs / source, 2)) if source and index else None
        k = self.metrics().first()
        failed = self._get("state").get("fallback_at")
        row = (1, bool(self.store.folder), probe["reachable"], index, probe["nodes"] <= 1, s["engine"] != "sql", bool(s["auto_indexing_enabled"]), state["state"] == "paused", self.vocabulary_pending(), probe["status"], probe["status"] or "green", probe["ping_ms"], gap, float(s["divergence_threshold_pct"]), docs, source, state["queue"], k["success_pct"], 0 if probe["reachable"] else 503, probe["error"], None if failed is None else int(self.clock() - failed))
        names = "id bigint, configured boolean, reachable boolean, index_exists boolean, single_node boolean, routing boolean, auto_indexing boolean, paused boolean, vocabulary_pending boolean, index_status string, cluster_status string, ping_ms bigint, divergence_pct double, threshold_pct double, index_docs bigint, source_docs bigint, queue_size bigint, success_pct double, http_code bigint, error string, fallback_age_s bigint"
        return self.spark.createDataFrame([row], names)

    def health(self, refresh: bool = False) -> dict:
        return self.cached("health", lambda: monitor.health(self.snapshot()).first().asDict(), refresh)  # type: ignore[return-value]

    def diagnostics(self) -> DataFrame:
        return monitor.explained(monitor.findings(self.snapshot()))

    def status(self) -> str:
        return monitor.light(self.snapshot()).first()["color"]

    def evaluate_alerts(self) -> DataFrame:
        """Raise what holds now; an alert's history is a row for each evaluation."""
        at = int(self.clock())
        now = monitor.alert_codes(self.snapshot()).select("code", F.lit(at).cast("long").alias("at"), F.lit(at).cast("long").alias("seq"), "severity", F.col("code").alias("message"))
        self.store.append("alerts", now)
        return self.alerts()

    def alerts(self) -> DataFrame:
        """What was raised, the graver first."""
        return monitor.by_severity(monitor.alert_store(self.store.read("alerts", ALERT)))

    def clear_alerts(self) -> None:
        self.store.write("alerts", self.spark.createDataFrame([], ALERT))

    # ------------------------------------------------ vocabulary

    def _lists(self, lists: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([(k, lists.get(k, "")) for k in vocabulary.LISTS], "list string, text string")

    def vocabulary(self) -> dict:
        return self._get("vocabulary")

    def save_vocabulary(self, lists: dict[str, str]) -> None:
        self._put("vocabulary", {k: lists.get(k, "") for k in vocabulary.LISTS})

    def validate_vocabulary(self, lists: dict[str, str]) -> DataFrame:
        return vocabulary.report(vocabulary.parse(vocabulary.lines(self._lists(lists))))

    def vocabulary_pending(self) -> bool:
        return vocabulary.pending(self.vocabulary(), self._get("applied").get("hash"), self.spark)

    def apply_vocabulary(self, stop: tuple[str, ...] = ()) -> int:
        """Put the saved lists into use, and how many rules that are. Nothing changes before the last step, nor if one before it fails:

        the lists are read and compiled; the rules are written to a place of their own and read back; a few are rehearsed
        as queries; then one row names rules, stop words and the lists they are of, together."""
        steps: list[dict] = []
        began = self.clock()

        def step(name: str, **found) -> None:
            steps.append({"step": name, "s": round(self.clock() - began, 3)} | found)

        with locked(self.store, "vocabulary", LOCK_S, began):
            lists = self.vocabulary()
            rules, words = vocabulary.apply(self._lists(lists), stop)
            custom = [r["word"] for r in words.collect()]
            row = self.spark.createDataFrame([tuple(lists.get(k, "") for k in vocabulary.LISTS)], [*vocabulary.LISTS]).select(vocabulary.lists_signature(*vocabulary.LISTS).alias("h")).first()
            step("compiled", stopwords=len(custom))
            staged = f"rules_{uuid.uuid4().hex[:12]}"
            self.store.write(staged, rules.select("list", "line", "rule", "note"))
            wanted = rules.select("list", "line", "rule")
            read = self._read_back(staged)
            if read.select("list", "line", "rule").exceptAll(wanted).take(1) or wanted.exceptAll(read.select("list", "line", "rule")).take(1):
                self.store.drop(staged)
                raise RuntimeError("the staged rules are not those that were compiled")
            n = read.count()
            step("staged", rules=n)
            try:
                samples = self.rehearse(self._parsed(read.orderBy("list", "line").limit(REHEARSED)), frozenset(custom))
            except Exception:
                self.store.drop(staged)
                raise
            step("rehearsed", samples=samples)
            before = self._get("applied")
            self._put("applied", before | {"hash": row["h"], "at": int(self.clock()), "stopwords": custom, "rules": staged, "steps": steps})
            if old := before.get("rules"):
                self.store.drop(old)
            return n

    def _read_back(self, staged: str) -> DataFrame:
        return self.store.read(staged, RULES)

    @staticmethod
    def _parsed(rows: DataFrame) -> list[tuple[list[str], list[str]]]:
        out = []
        for r in rows.select("rule").collect():
            left, _, right = r["rule"].partition(" => ")
            out.append((left.split(", "), right.split(", ") if right else []))
        return out

    def rehearse(self, rules: list[tuple[list[str], list[str]]], stop: frozenset[str] = frozenset()) -> list[dict]:
        """What the first term of each rule becomes as a query under these rules; an error if it doesn't become what the rule says."""
        index = TextIndex.build(Catalogue(self.spark.createDataFrame([], ITEM)))
        samples = []
        for left, right in rules:
            lat = index.lattice(left[0], Options(rules=tuple(rules), stop=stop))
            forms = [" ".join(w) for w in lat.ways()]
            if lat.length and not set(forms) & set(right or left):
                raise RuntimeError(f"{left[0]} becomes {', '.join(forms)}")
            samples.append({"text": left[0], "forms": forms})
        return samples

    def rules(self) -> list[tuple[list[str], list[str]]]:
        """What is in use, for queries: at most the rules' cap; none before any were applied."""
        name = self._get("applied").get("rules")
        return self._parsed(self.store.read(name, RULES)) if name else []

    def test_vocabulary(self, text: str, fields: tuple[str, ...] = ("title", "content")) -> dict:
        """A query's forms, and how many published items match it: with the vocabulary, its last word completed if need be, and without either."""
        items = self.index.read().where("post_status = 'publish'")
        index = TextIndex.build(Catalogue(items), fields=fields)
        using = Options(rules=tuple(self.rules()), stop=frozenset(self._get("applied").get("stopwords", ())))
        return {
            "forms": [" ".join(w) for w in index.lattice(text, using).ways()],
            "with": index.search(text, using).count(),
            "without": index.all(text).count(),
        }
