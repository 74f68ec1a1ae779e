"""Index monitoring: coverage, rolling indicators, failures, alerts, health, diagnosis, traffic light."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators import ordered

#: Limits of the rules.
SLOW_MS, SUCCESS_WARNING, SUCCESS_CRITICAL = 2000, 80, 50
RING, ROLLING, TOP_FAILURES = 200, 10, 20
SEVERITIES = ("ok", "info", "warning", "critical")


def coverage_columns(indexed: Column, source: Column, threshold: float) -> dict[str, Column]:
    pct = F.when(source > 0, F.round(indexed / source * 100, 2))
    gap = F.greatest(F.lit(0.0), F.round(100 - pct, 2))
    return {"coverage_pct": pct, "divergence_pct": F.when(pct.isNotNull(), gap), "over_threshold": F.coalesce(gap > threshold, F.lit(False))}


def coverage(source: DataFrame, indexed: DataFrame, collection: str, threshold: float = 5.0) -> DataFrame:
    """By collection: items in the source and in the index, coverage and divergence; counts items, never entries."""
    a = source.groupBy(collection).agg(F.count(F.lit(1)).alias("source_count"))
    b = indexed.groupBy(collection).agg(F.count(F.lit(1)).alias("indexed_count"))
    j = a.join(b, collection, "left").withColumn("indexed_count", F.coalesce("indexed_count", F.lit(0)))
    return j.withColumns(coverage_columns(F.col("indexed_count"), F.col("source_count"), threshold))


def ring(runs: DataFrame, n: int = RING) -> DataFrame:
    """The last n runs: a top-k."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def kpis(runs: DataFrame, queue_size: int = 0, n: int = ROLLING) -> DataFrame:
    """Over the last n runs: sums, items a second, success rate, mean duration and size, seconds to empty the queue."""
    last = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)
    s = last.agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in ("indexed", "failed", "built", "duration_ms")], F.min("ts").alias("first"), F.max("ts").alias("last"))
    ips = F.when(F.col("runs") >= 2, F.col("indexed") / F.greatest(F.lit(1), F.col("last") - F.col("first"))).when(F.col("duration_ms") > 0, F.col("indexed") / (F.col("duration_ms") / 1000))
    return s.select(
        "runs", "indexed", "failed",
        F.round(ips, 4).alias("items_per_second"),
        F.when(F.col("indexed") + F.col("failed") > 0, F.round(100 * F.col("indexed") / (F.col("indexed") + F.col("failed")), 2)).alias("success_pct"),
        F.round(F.col("duration_ms") / F.col("runs")).cast("long").alias("avg_ms"),
        F.round(F.col("built") / F.col("runs"), 1).alias("avg_size"),
        F.when(ips > 0, F.round(F.lit(queue_size) / ips)).cast("long").alias("eta_s"),
    )


_IN_TIME = ["ts", "run_id"]


def rolling(runs: DataFrame, n: int = ROLLING, key: str = "event_type") -> DataFrame:
    """At each run of a key: sums over it and the n - 1 before."""
    rows = ordered.sliding(runs.select(key, "run_id", "ts", "indexed", "duration_ms"), _IN_TIME, key, n, {"indexed_n": F.col("indexed"), "duration_n": F.col("duration_ms")})
    return rows.select(key, "run_id", "indexed_n", "duration_n")


def cumulative(runs: DataFrame, key: str = "event_type") -> DataFrame:
    """Lifetime counters after each run of a key."""
    sums = {"indexed_total": F.greatest("indexed", F.lit(0)), "failed_total": F.greatest("failed", F.lit(0))}
    return ordered.running(runs.select(key, "run_id", "ts", "indexed", "failed"), _IN_TIME, key, sums).select(key, "run_id", *sums)


def lifetime(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.greatest("indexed", F.lit(0))).alias("indexed"), F.sum(F.greatest("failed", F.lit(0))).alias("failed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("duration_ms").alias("peak_ms"))


def sparkline(runs: DataFrame, n: int = 50) -> DataFrame:
    """The last n durations in order of time, as one array."""
    last = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)
    return last.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "run_id", "duration_ms"))), lambda x: x["duration_ms"]).alias("series"))


def top_failures(runs: DataFrame, n: int = TOP_FAILURES) -> DataFrame:
    return runs.where("failed > 0").groupBy("item_id").agg(F.sum("failed").alias("n")).orderBy(F.desc("n"), "item_id").limit(n)


def shares(counts: DataFrame) -> DataFrame:
    """Of (label, n): the share in percent with one decimal."""
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # labels are few
    return counts.withColumn("total", total).select("label", "n", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 1)).otherwise(0.0).alias("pct"))


def severity_rank(c: str = "severity") -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c)), F.lit(0)) - 1, F.lit(0))


def worst(findings: DataFrame, key: str) -> DataFrame:
    """By key the highest severity of its findings."""
    top = findings.groupBy(key).agg(F.max(severity_rank()).alias("r"))
    return top.select(key, F.get(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int")).alias("severity"))


def transitions(alerts: DataFrame) -> DataFrame:
    """Of (code, at, severity, message): how often each alert was raised anew: the first time and at every change."""
    w = Window.partitionBy("code").orderBy("at", "seq")
    same = (F.lag("severity").over(w) == F.col("severity")) & (F.lag("message").over(w) == F.col("message"))
    marked = alerts.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("long"))
    return marked.groupBy("code").agg(F.sum("new").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def alert_store(alerts: DataFrame) -> DataFrame:
    """The same with each alert's last severity and message."""
    last = alerts.groupBy("code").agg(F.max(F.struct("at", "seq", "severity", "message")).alias("l")).select("code", "l.severity", "l.message")
    return transitions(alerts).join(last, "code")


def by_severity(alerts: DataFrame) -> DataFrame:
    """Alerts (code, severity, ...), the graver first, the last seen first within a severity."""
    return alerts.orderBy(F.desc(severity_rank()), F.desc("last_seen"), "code")


def laps(steps: DataFrame) -> DataFrame:
    """Of (k, at): time since the step before."""
    return steps.withColumn("lap", F.col("at") - F.lag("at").over(Window.partitionBy("k").orderBy("at", "seq")))


def shard_status() -> Column:
    """The index' own status before the cluster's; yellow on a single node is green. Null if unknown."""
    own = F.coalesce(F.nullif("index_status", F.lit("")), F.nullif("cluster_status", F.lit("")))
    return F.when((own == "yellow") & F.col("single_node"), "green").otherwise(own)


def health(snapshots: DataFrame) -> DataFrame:
    """Snapshots with overall status and reason, the first rule that holds."""
    s = shard_status()
    gap = F.coalesce(F.col("divergence_pct") > F.col("threshold_pct"), F.lit(False))
    reason = F.when(~F.col("configured"), "unconfigured").when(~F.col("reachable"), "unreachable").when(s == "red", "red").when(s == "yellow", "yellow").when(~F.col("index_exists"), "no_index").when(gap, "divergence").otherwise("ok")
    status = F.when(reason.isin("unconfigured", "unreachable", "red"), "critical").when(reason == "ok", "ok").otherwise("warning")
    return snapshots.withColumns({"reason": reason, "status": status})


def alert_codes(snapshots: DataFrame) -> DataFrame:
    """id, code and severity of the alerts that each snapshot raises; an unreachable engine hides the rest."""
    s, up = shard_status(), F.col("configured") & F.col("reachable")
    gap = F.coalesce(F.col("divergence_pct") > F.col("threshold_pct"), F.lit(False))
    rules = [
        ("es_not_configured", "critical", ~F.col("configured")),
        ("es_unreachable", "critical", F.col("configured") & ~F.col("reachable")),
        ("cluster_red", "critical", up & (s == "red")),
        ("cluster_yellow", "warning", up & (s == "yellow")),
        ("cluster_yellow_single_node", "info", up & (F.col("index_status") == "yellow") & F.col("single_node")),
        ("index_divergence", "warning", up & gap),
        ("es_slow", "warning", up & (F.col("ping_ms") > SLOW_MS)),
    ]
    return _explode_rules(snapshots, rules)


def _explode_rules(snapshots: DataFrame, rules: list[tuple[str, str | Column, Column]]) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    rows = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(code).alias("code"), lit(sev).alias("severity"))) for code, sev, hit in rules]
    return snapshots.select("id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("id", "r.code", "r.severity")


def findings(snapshots: DataFrame) -> DataFrame:
    """The diagnosis of each snapshot as (id, code, severity) rows; early returns hide what follows, and ``ok`` joins where all is information at most."""
    configured, up = F.col("configured"), F.col("configured") & F.col("reachable")
    there = up & F.col("index_exists")
    own = F.coalesce("index_status", "cluster_status")
    error = F.lower(F.coalesce("error", F.lit("")))
    denied = F.coalesce(F.col("http_code").isin(401, 403), F.lit(False))
    dns = reduce(Column.__or__, [F.contains(error, F.lit(x)) for x in ("name or service not known", "could not resolve host", "getaddrinfo")])
    timeout = reduce(Column.__or__, [F.contains(error, F.lit(x)) for x in ("timeout", "timed out", "connection refused")])
    down = configured & ~F.col("reachable")
    gap = F.coalesce(F.col("divergence_pct") > F.col("threshold_pct"), F.lit(False))
    initial = (F.col("index_docs") == 0) & (F.col("source_docs") > 0)
    low = F.col("success_pct") < SUCCESS_WARNING
    rules: list[tuple[str, str | Column, Column]] = [
        ("unconfigured", "critical", ~configured),
        ("denied", "critical", down & denied),
        ("dns", "critical", down & ~denied & dns),
        ("timeout", "critical", down & ~denied & ~dns & timeout),
        ("unreachable", "critical", down & ~denied & ~dns & ~timeout),
        ("no_index", "warning", up & ~F.col("index_exists")),
        ("red", "critical", there & (own == "red")),
        ("yellow", F.when(F.col("single_node"), "info").otherwise("warning"), there & (own == "yellow")),
        ("shared_cluster", "info", there & (F.col("index_status") == "green") & F.col("cluster_status").isin("yellow", "red")),
        ("slow", "warning", there & (F.col("ping_ms") > SLOW_MS)),
        ("coverage", F.when(initial, "info").otherwise("warning"), there & gap),
        ("manual_queue", "info", there & (F.col("queue_size") > 0) & ~F.col("auto_indexing")),
        ("failures", F.when(F.col("success_pct") < SUCCESS_CRITICAL, "critical").otherwise("warning"), there & low),
        ("vocabulary", "info", there & F.col("vocabulary_pending")),
        ("paused", "warning", there & F.col("paused")),
    ]
    problem = reduce(Column.__or__, [F.coalesce(hit & (sev != "info" if isinstance(sev, Column) else F.lit(sev != "info")), F.lit(False)) for _, sev, hit in rules])
    return _explode_rules(snapshots, [*rules, ("ok", "ok", ~problem)])


#: Of each finding: what it is, and what to do about it.
FINDING_TEXTS = {
    "unconfigured": ("No index is set up", "Set the folder of the index."),
    "denied": ("The storage refuses access", "Check the name and the password or key."),
    "dns": ("The host's name is unknown", "Check the address and the name service."),
    "timeout": ("The storage does not answer in time", "Check that it runs and that nothing between blocks it."),
    "unreachable": ("The storage can't be reached", "Look at the error and at the storage's own log."),
    "no_index": ("There is no index yet", "Create it and enqueue all items."),
    "red": ("A part of the index can't be read", "Restore the missing files or build the index anew."),
    "yellow": ("The index waits for rows that were refused", "Look at the failures and enqueue them again."),
    "shared_cluster": ("The index is sound, other tables are not", "Nothing to do here; tell who owns them."),
    "slow": ("Answers are slow", "Look at the load; give the job more tasks."),
    "coverage": ("The index lacks items of the source", "Enqueue what is missing."),
    "manual_queue": ("The queue waits and nothing works it off", "Process it, or turn automatic indexing on."),
    "failures": ("Many rows fail", "Look at the kinds of errors in the log."),
    "vocabulary": ("The vocabulary was changed but isn't in use", "Apply it."),
    "paused": ("Indexing is paused", "Resume it."),
    "ok": ("All is well", ""),
}


def explained(findings: DataFrame) -> DataFrame:
    """Findings with a title and what to do, the graver first."""
    text = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in FINDING_TEXTS.items() for x in (k, v[i])]), F.col("code"))
    return findings.withColumns({"title": text(0), "action": text(1)}).orderBy(F.desc(severity_rank()), "code")


def light(snapshots: DataFrame) -> DataFrame:
    """id and colour: off, red on any failed check, yellow on any warning, else green. The vocabulary never counts."""
    s, up = shard_status(), F.col("configured") & F.col("reachable")
    fail = ~up | (up & (~F.col("index_exists") | F.coalesce(s == "red", F.lit(False))))
    gap = F.coalesce(F.col("divergence_pct") > F.col("threshold_pct"), F.lit(False))
    queue = F.col("paused") | ((F.col("queue_size") > 0) & ~F.col("auto_indexing"))
    warn = (up & (F.coalesce(s == "yellow", F.lit(False)) | F.coalesce(F.col("ping_ms") > SLOW_MS, F.lit(False)))) | gap | queue | F.coalesce(F.col("fallback_age_s") < 900, F.lit(False))
    return snapshots.select("id", F.when(~F.col("routing"), "off").when(fail, "red").when(warn, "yellow").otherwise("green").alias("color"))


def remembered(lights: DataFrame) -> DataFrame:
    """Of (k, at, color): the first row and every change of colour."""
    before = F.lag("color").over(Window.partitionBy("k").orderBy("at", "seq"))
    return lights.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("color"))).drop("before")


def success_class(c: str = "success_pct") -> Column:
    return F.when(F.col(c) >= 95, "ok").when(F.col(c) >= 80, "warning").otherwise("critical")
