"""Queries of queue, log and monitoring operators over events taken as runs, calls and log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.operators import monitor, queue
from vitrine.plans.registry import query
from vitrine.sources import catalogue as c
from vitrine.sources import files

RUNS = "runs AS (SELECT event_id AS run_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(floor(value) AS BIGINT) AS duration_ms, (event_type <> 'error')::BIGINT AS indexed, (event_type = 'error')::BIGINT AS failed, user_id AS item_id, event_type FROM events)"
EVENT_S = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(
    "coverage_by_collection",
    """WITH s AS (SELECT source, count(*) AS source_count FROM documents GROUP BY 1), i AS (SELECT source, count(*) AS indexed_count FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    j AS (SELECT s.*, coalesce(indexed_count, 0) AS indexed_count FROM s LEFT JOIN i USING (source)), p AS (SELECT *, round(indexed_count / source_count * 100, 2) AS coverage_pct FROM j)
    SELECT *, greatest(0, round(100 - coverage_pct, 2)) AS divergence_pct, greatest(0, round(100 - coverage_pct, 2)) > 60 AS over_threshold FROM p""",
)
def coverage_by_collection(spark, sf):
    docs = c.table(spark, sf, "documents").select("doc_id", "source")
    return monitor.coverage(docs, docs.join(c.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), "source", 60)


@query("global_coverage", "SELECT n AS indexed, m AS source, round(n / m * 100, 2) AS coverage_pct, greatest(0, round(100 - round(n / m * 100, 2), 2)) AS divergence_pct FROM (SELECT (SELECT count(*) FROM labels) AS n, (SELECT count(*) FROM documents) AS m)")
def global_coverage(spark, sf):
    both = c.table(spark, sf, "documents").select("doc_id").join(c.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("i")), "doc_id", "left").agg(F.count("i").alias("indexed"), F.count(F.lit(1)).alias("source"))
    cols = monitor.coverage_columns(F.col("indexed"), F.col("source"), 5)
    return both.select("indexed", "source", cols["coverage_pct"].alias("coverage_pct"), cols["divergence_pct"].alias("divergence_pct"))


@query(
    "run_kpis",
    f"""WITH {RUNS}, l AS (SELECT * FROM runs ORDER BY ts DESC, run_id DESC LIMIT 10),
    s AS (SELECT count(*) AS runs, sum(indexed) AS indexed, sum(failed) AS failed, sum(duration_ms) AS d, max(ts) - min(ts) AS t FROM l)
    SELECT runs, CAST(indexed AS BIGINT) AS indexed, CAST(failed AS BIGINT) AS failed, round(indexed / greatest(1, t), 4) AS items_per_second, round(100 * indexed / (indexed + failed), 2) AS success_pct,
    CAST(round(d / runs) AS BIGINT) AS avg_ms, 1.0 AS avg_size, CAST(round(500 / (indexed / greatest(1, t))) AS BIGINT) AS eta_s FROM s""",
)
def run_kpis(spark, sf):
    return monitor.kpis(c.runs(spark, sf), 500)


@query("run_ring", f"WITH {RUNS} SELECT run_id, ts, duration_ms FROM runs ORDER BY ts DESC, run_id DESC LIMIT 200")
def run_ring(spark, sf):
    return monitor.ring(c.runs(spark, sf)).select("run_id", "ts", "duration_ms")


@query("run_rolling", f"WITH {RUNS} SELECT event_type, run_id, CAST(sum(indexed) OVER w AS BIGINT) AS indexed_n, CAST(sum(duration_ms) OVER w AS BIGINT) AS duration_n FROM runs WINDOW w AS (PARTITION BY event_type ORDER BY ts, run_id ROWS 9 PRECEDING)")
def run_rolling(spark, sf):
    return monitor.rolling(c.runs(spark, sf))


@query("run_cumulative", f"WITH {RUNS} SELECT event_type, run_id, CAST(sum(indexed) OVER w AS BIGINT) AS indexed_total, CAST(sum(failed) OVER w AS BIGINT) AS failed_total FROM runs WINDOW w AS (PARTITION BY event_type ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING)")
def run_cumulative(spark, sf):
    return monitor.cumulative(c.runs(spark, sf))


@query("run_lifetime", f"WITH {RUNS} SELECT count(*) AS runs, CAST(sum(indexed) AS BIGINT) AS indexed, CAST(sum(failed) AS BIGINT) AS failed, min(ts) AS first_ts, max(ts) AS last_ts, max(duration_ms) AS peak_ms FROM runs")
def run_lifetime(spark, sf):
    return monitor.lifetime(c.runs(spark, sf))


@query("run_sparkline", f"WITH {RUNS}, l AS (SELECT * FROM runs ORDER BY ts DESC, run_id DESC LIMIT 50) SELECT array_to_string(list(duration_ms ORDER BY ts, run_id), ',') AS series FROM l")
def run_sparkline(spark, sf):
    return monitor.sparkline(c.runs(spark, sf)).select(F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


@query("failure_top", f"WITH {RUNS} SELECT item_id, CAST(sum(failed) AS BIGINT) AS n FROM runs WHERE failed > 0 GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20")
def failure_top(spark, sf):
    return monitor.top_failures(c.runs(spark, sf))


@query("failure_count", f"WITH {RUNS} SELECT count(DISTINCT item_id) AS n FROM runs WHERE failed > 0")
def failure_count(spark, sf):
    return c.runs(spark, sf).where("failed > 0").select("item_id").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("error_summary", "SELECT event_type AS type, count(*) AS n, min_by(props, event_id) AS sample_reason, min_by(user_id, event_id) AS sample_id FROM events GROUP BY 1")
def error_summary(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("ord"), F.col("props").alias("reason"), F.col("user_id").alias("item_id"))
    return queue.error_summary(e)


@query("event_shares", "SELECT event_type AS label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 1) AS pct FROM events GROUP BY 1")
def event_shares(spark, sf):
    return monitor.shares(c.table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "breaker_streaks",
    f"""WITH e AS (SELECT user_id AS k, event_id AS "at", event_type <> 'error' AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY k ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS island FROM e)
    SELECT k, "at", ok, row_number() OVER (PARTITION BY k, island ORDER BY "at") AS streak FROM g WHERE NOT ok""",
)
def breaker_streaks(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return queue.streaks(e)


@query(
    "breaker_state",
    f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS k, {EVENT_S} AS "at", CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'ignored' ELSE 'ok' END AS outcome FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at", outcome) AS i FROM e),
    s AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS "at", '' AS outcome, '' AS state, 0::BIGINT AS fails, 0::BIGINT AS until FROM (SELECT DISTINCT k FROM e)
      UNION ALL SELECT k, i, "at", outcome, CASE WHEN "at" < until THEN 'refused' WHEN f >= 3 THEN 'opened' ELSE 'closed' END, CASE WHEN "at" < until THEN fails WHEN f >= 3 THEN 0 ELSE f END, CASE WHEN "at" >= until AND f >= 3 THEN "at" + 120 ELSE until END
      FROM (SELECT n.k, n.i, n."at", n.outcome, s.fails, s.until, CASE n.outcome WHEN 'ok' THEN 0 WHEN 'fail' THEN s.fails + 1 ELSE s.fails END AS f FROM s JOIN n ON n.k = s.k AND n.i = s.i + 1))
    SELECT k, "at", outcome, state, fails AS failures FROM s WHERE i > 0""",
)
def breaker_state(spark, sf):
    e = c.table(spark, sf, "events")
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "ignored").otherwise("ok")
    return queue.breaker(e.select(F.col("user_id").cast("string").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), outcome.alias("outcome")))


@query(
    "throttled",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k, {EVENT_S} AS "at" FROM events),
    n AS (SELECT a.k, a."at", min(b."at") AS next FROM e a JOIN e b ON a.k = b.k AND b."at" >= a."at" + 3600 GROUP BY 1, 2),
    t AS (SELECT k, min("at") AS "at" FROM e GROUP BY k UNION ALL SELECT t.k, n.next FROM t JOIN n ON n.k = t.k AND n."at" = t."at")
    SELECT k, "at" FROM t""",
)
def throttled(spark, sf):
    return queue.throttle(c.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), 3600)


@query(
    "alert_transitions",
    f"""WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS code, {EVENT_S} AS "at", event_id AS seq, event_type AS severity, 'm' AS message FROM events),
    m AS (SELECT *, coalesce(lag(severity) OVER (PARTITION BY code ORDER BY "at", seq) = severity, false) AS same FROM e)
    SELECT code, CAST(sum((NOT same)::INT) AS BIGINT) AS n, min("at") AS first_seen, max("at") AS last_seen FROM m GROUP BY code""",
)
def alert_transitions(spark, sf):
    e = c.table(spark, sf, "events")
    return monitor.transitions(e.select((F.col("user_id") % 50).cast("string").alias("code"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("severity"), F.lit("m").alias("message")))


@query("remembered_light", f"WITH e AS (SELECT user_id AS k, {EVENT_S} AS \"at\", event_id AS seq, event_type AS color FROM events) SELECT k, \"at\", seq, color FROM e QUALIFY lag(color) OVER (PARTITION BY k ORDER BY \"at\", seq) IS DISTINCT FROM color")
def remembered_light(spark, sf):
    e = c.table(spark, sf, "events")
    return monitor.remembered(e.select(F.col("user_id").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("color")))


@query("step_laps", f"SELECT user_id AS k, event_id AS seq, {EVENT_S} AS \"at\", {EVENT_S} - lag({EVENT_S}) OVER (PARTITION BY user_id ORDER BY {EVENT_S}, event_id) AS lap FROM events")
def step_laps(spark, sf):
    e = c.table(spark, sf, "events")
    return monitor.laps(e.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))


def _queue(spark, sf):
    return c.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("item_id"), F.col("event_id").alias("enqueued_at"))


QUEUED = "o AS (SELECT user_id AS item_id, min(event_id) AS enqueued_at FROM events WHERE event_id < 500 AND user_id > 0 GROUP BY 1), n AS (SELECT user_id AS item_id, min(event_id) AS enqueued_at FROM events WHERE event_id >= 500 AND user_id > 0 GROUP BY 1), q AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE item_id NOT IN (SELECT item_id FROM o))"


def _queued(spark, sf):
    e = _queue(spark, sf)
    empty = e.where(F.lit(False))
    return queue.enqueue(queue.enqueue(empty, e.where("enqueued_at < 500")), e.where("enqueued_at >= 500"))


@query("queue_dedup", f"WITH {QUEUED} SELECT item_id, enqueued_at FROM q")
def queue_dedup(spark, sf):
    return _queued(spark, sf)


@query("queue_next_batch", f"WITH {QUEUED} SELECT item_id FROM q ORDER BY enqueued_at, item_id LIMIT 50")
def queue_next_batch(spark, sf):
    return queue.next_batch(_queued(spark, sf), 50)


@query("queue_size", f"WITH {QUEUED} SELECT count(*) AS n FROM q")
def queue_size(spark, sf):
    return _queued(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query(
    "retry_or_drop",
    """WITH e AS (SELECT user_id AS item_id, event_id AS "at", event_type <> 'error' AS ok FROM events), f AS (SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY item_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM e)
    SELECT *, CASE WHEN ok THEN 'done' WHEN failures <= 3 THEN 'retry' ELSE 'drop' END AS verdict FROM f""",
)
def retry_or_drop(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return queue.retry_or_drop(e)


def _logs(spark, sf):
    e = c.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("channel"), F.concat(F.lit("<b>"), "event_type", F.lit("</b> by "), F.col("user_id").cast("string")).alias("message"), F.concat(F.lit('{"api_token":"x'), F.col("user_id").cast("string"), F.lit('","k":"v"}')).alias("context"))


@query("log_page", "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20 OFFSET 20")
def log_page(spark, sf):
    return files.log_page(_logs(spark, sf), level="error", per_page=20, page=2).select("id")


@query("log_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def log_count(spark, sf):
    return _logs(spark, sf).where("channel = 'click'").agg(F.count(F.lit(1)).alias("n"))


@query("log_scrub", """SELECT event_id AS id, event_type || ' by ' || user_id AS message, '{"api_token":"***redacted***","k":"v"}' AS context FROM events""")
def log_scrub(spark, sf):
    return files.log_rows(_logs(spark, sf)).select("id", "message", "context")


@query("log_retention", "SELECT event_id AS id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def log_retention(spark, sf):
    logs = _logs(spark, sf)
    return files.retained(logs, logs.agg(F.max("created_at")).first()[0], 7).select("id")


SNAPSHOT = {
    "configured": "id % 17 <> 0", "reachable": "id % 13 <> 0", "index_exists": "id % 11 <> 0", "single_node": "id % 2 = 0", "routing": "id % 19 <> 0", "auto_indexing": "id % 3 <> 0",
    "paused": "id % 23 = 0", "vocabulary_pending": "id % 5 = 0",
    "index_status": "CASE id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' END", "cluster_status": "CASE id % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END",
    "ping_ms": "(id * 37) % 3000", "divergence_pct": "(id % 10) * 1.0e0", "threshold_pct": "5.0e0", "index_docs": "id % 7", "source_docs": "id % 6", "queue_size": "id % 4",
    "success_pct": "CASE WHEN id % 6 > 0 THEN (id % 101) * 1.0e0 END", "http_code": "CASE WHEN id % 26 = 0 THEN 401 ELSE 0 END",
    "error": "CASE id % 3 WHEN 0 THEN 'Could not resolve host: x' WHEN 1 THEN 'Operation timed out' ELSE '' END", "fallback_age_s": "(id * 7) % 2000",
}
SNAPSHOTS = "s AS (SELECT event_id AS id FROM events), snap AS (SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in SNAPSHOT.items()) + " FROM s), sh AS (SELECT *, CASE WHEN coalesce(index_status, cluster_status) = 'yellow' AND single_node THEN 'green' ELSE coalesce(index_status, cluster_status) END AS shard FROM snap)"


def _snapshots(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return e.select("id", *[F.expr(x).alias(n) for n, x in SNAPSHOT.items()])


@query(
    "health_class",
    f"""WITH {SNAPSHOTS}, r AS (SELECT id, CASE WHEN NOT configured THEN 'unconfigured' WHEN NOT reachable THEN 'unreachable' WHEN shard = 'red' THEN 'red' WHEN shard = 'yellow' THEN 'yellow'
    WHEN NOT index_exists THEN 'no_index' WHEN divergence_pct > threshold_pct THEN 'divergence' ELSE 'ok' END AS reason FROM sh)
    SELECT id, reason, CASE WHEN reason IN ('unconfigured', 'unreachable', 'red') THEN 'critical' WHEN reason = 'ok' THEN 'ok' ELSE 'warning' END AS status FROM r""",
)
def health_class(spark, sf):
    return monitor.health(_snapshots(spark, sf)).select("id", "reason", "status")


@query(
    "alert_codes",
    f"""WITH {SNAPSHOTS} SELECT id, 'es_not_configured' AS code, 'critical' AS severity FROM sh WHERE NOT configured
    UNION ALL SELECT id, 'es_unreachable', 'critical' FROM sh WHERE configured AND NOT reachable
    UNION ALL SELECT id, 'cluster_' || shard, CASE shard WHEN 'red' THEN 'critical' ELSE 'warning' END FROM sh WHERE configured AND reachable AND shard IN ('red', 'yellow')
    UNION ALL SELECT id, 'cluster_yellow_single_node', 'info' FROM sh WHERE configured AND reachable AND index_status = 'yellow' AND single_node
    UNION ALL SELECT id, 'index_divergence', 'warning' FROM sh WHERE configured AND reachable AND divergence_pct > threshold_pct
    UNION ALL SELECT id, 'es_slow', 'warning' FROM sh WHERE configured AND reachable AND ping_ms > 2000""",
)
def alert_codes(spark, sf):
    return monitor.alert_codes(_snapshots(spark, sf))


FINDINGS = f"""WITH {SNAPSHOTS}, u AS (SELECT *, coalesce(index_status, cluster_status) AS own FROM sh), t AS (SELECT * FROM u WHERE configured AND reachable AND index_exists),
d AS (SELECT *, CASE WHEN http_code IN (401, 403) THEN 'denied' WHEN contains(lower(error), 'could not resolve host') THEN 'dns' WHEN contains(lower(error), 'timed out') THEN 'timeout' ELSE 'unreachable' END AS why
  FROM u WHERE configured AND NOT reachable),
f AS (SELECT id, 'unconfigured' AS code, 'critical' AS severity FROM u WHERE NOT configured UNION ALL SELECT id, why, 'critical' FROM d
  UNION ALL SELECT id, 'no_index', 'warning' FROM u WHERE configured AND reachable AND NOT index_exists
  UNION ALL SELECT id, 'red', 'critical' FROM t WHERE own = 'red' UNION ALL SELECT id, 'yellow', CASE WHEN single_node THEN 'info' ELSE 'warning' END FROM t WHERE own = 'yellow'
  UNION ALL SELECT id, 'shared_cluster', 'info' FROM t WHERE index_status = 'green' AND cluster_status IN ('yellow', 'red')
  UNION ALL SELECT id, 'slow', 'warning' FROM t WHERE ping_ms > 2000
  UNION ALL SELECT id, 'coverage', CASE WHEN index_docs = 0 AND source_docs > 0 THEN 'info' ELSE 'warning' END FROM t WHERE divergence_pct > threshold_pct
  UNION ALL SELECT id, 'manual_queue', 'info' FROM t WHERE queue_size > 0 AND NOT auto_indexing
  UNION ALL SELECT id, 'failures', CASE WHEN success_pct < 50 THEN 'critical' ELSE 'warning' END FROM t WHERE success_pct < 80
  UNION ALL SELECT id, 'vocabulary', 'info' FROM t WHERE vocabulary_pending UNION ALL SELECT id, 'paused', 'warning' FROM t WHERE paused),
g AS (SELECT * FROM f UNION ALL SELECT id, 'ok', 'ok' FROM u WHERE id NOT IN (SELECT id FROM f WHERE severity <> 'info'))"""


@query("diagnosis_findings", f"{FINDINGS} SELECT id, code, severity FROM g")
def diagnosis_findings(spark, sf):
    return monitor.findings(_snapshots(spark, sf))


@query("diagnosis_rollup", f"{FINDINGS} SELECT id, ['ok', 'info', 'warning', 'critical'][max(CASE severity WHEN 'ok' THEN 1 WHEN 'info' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END)] AS severity FROM g GROUP BY id")
def diagnosis_rollup(spark, sf):
    return monitor.worst(monitor.findings(_snapshots(spark, sf)), "id")


@query(
    "traffic_light",
    f"""WITH {SNAPSHOTS} SELECT id, CASE WHEN NOT routing THEN 'off' WHEN NOT configured OR NOT reachable OR NOT index_exists OR shard = 'red' THEN 'red'
    WHEN shard = 'yellow' OR ping_ms > 2000 OR divergence_pct > threshold_pct OR paused OR (queue_size > 0 AND NOT auto_indexing) OR fallback_age_s < 900 THEN 'yellow' ELSE 'green' END AS color FROM sh""",
)
def traffic_light(spark, sf):
    return monitor.light(_snapshots(spark, sf))


@query("success_classes", f"WITH {SNAPSHOTS} SELECT id, CASE WHEN success_pct >= 95 THEN 'ok' WHEN success_pct >= 80 THEN 'warning' ELSE 'critical' END AS class FROM snap")
def success_classes(spark, sf):
    return _snapshots(spark, sf).select("id", monitor.success_class().alias("class"))


@query(
    "humanize_seconds",
    """SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'min ' || s % 60 || 's' WHEN s < 86400 THEN s // 3600 || 'h ' || (s % 3600) // 60 || 'min'
    ELSE s // 86400 || 'd ' || (s % 86400) // 3600 || 'h' END AS text FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 200000 AS s FROM orders)""",
)
def humanize_seconds(spark, sf):
    o = c.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 200000).alias("s"))
    return o.select("id", tx.humanize_seconds("s").alias("text"))


@query("sanitize_index_name", "SELECT p_partkey AS id, regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9_-]', '', 'g') AS name, 'tnc_' || substr(md5(p_name), 1, 8) || '_items' AS fallback FROM part")
def sanitize_index_name(spark, sf):
    p = c.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.sanitize_index_name(F.concat_ws(" / ", "p_brand", "p_name")).alias("name"), tx.default_index_name("p_name").alias("fallback"))


@query("parse_credentials", "SELECT page_id, 'user' AS usr, 'p@' || page_id AS pw, url AS bare FROM pages")
def parse_credentials(spark, sf):
    u = c.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^(https?://)", F.concat(F.lit("$1user:p@"), F.col("page_id").cast("string"), F.lit("@"))).alias("u"))
    return u.select("page_id", tx.url_user("u").alias("usr"), tx.url_password("u").alias("pw"), tx.url_bare("u").alias("bare"))


@query(
    "sniffed_cells",
    """WITH n AS (SELECT r_name, list(n_name ORDER BY n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
    SELECT r_name || ', ' || array_to_string(n, ', ') AS text FROM n UNION ALL SELECT r_name || ' => ' || array_to_string(n, ', ') FROM n UNION ALL SELECT unnest(list_prepend(r_name, n)) FROM n""",
)
def sniffed_cells(spark, sf):
    """Cells as read_delimited() gives them, a region and its nations each, as lines of the three kinds of list."""
    n = c.table(spark, sf, "nation").join(c.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    cells = n.select(F.concat(F.array("r_name"), "n").alias("cells"))
    return files.cells_to_lines(cells, "synonyms").unionByName(files.cells_to_lines(cells, "corrections")).unionByName(files.cells_to_lines(cells, "stopwords"))


@query("json_export", """SELECT event_id AS id, '{"id":' || event_id || ',"channel":"' || event_type || '"}' AS line FROM events""")
def json_export(spark, sf):
    logs = _logs(spark, sf)
    return logs.select("id", F.to_json(F.struct("id", "channel")).alias("line"))
