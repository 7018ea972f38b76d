"""Queries over operation metrics (``events``: type = operation, value = duration) and generic tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from notelake.operators import caches, lookup, metrics
from notelake.plans import as_bigint
from notelake.session import load

_AT = ["started_at", "event_id"]
_PERIOD = ("2024-01-02 00:30:00", "2024-02-15 00:00:00")


def _ops(spark, folder):
    return load(spark, folder, "events").select("event_id", F.col("event_type").alias("operation_type"), F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"), "user_id")


def _r(c, n=6):
    return F.round(c, n).alias(c)


def average_metrics(spark, folder):
    return metrics.average_metrics(_ops(spark, folder)).select("operation_type", "operations", _r("mean_duration_ms"))


def average_metrics_with_missing(spark, folder):
    ops = _ops(spark, folder).withColumn("duration_ms", F.when(F.col("event_id") % 7 != 0, F.col("duration_ms")))
    return metrics.average_metrics(ops, True).select("operation_type", "operations", _r("mean_duration_ms"))


def hourly_trends(spark, folder):
    return metrics.hourly_trends(_ops(spark, folder)).select("hour", "operation_type", "operations", _r("mean_duration_ms"))


def hourly_trends_from(spark, folder):
    return metrics.hourly_trends(_ops(spark, folder), "2024-01-02 00:30:00").select("hour", "operation_type", "operations", _r("mean_duration_ms"))


def resource_summary(spark, folder):
    return metrics.resource_summary(_ops(spark, folder), "duration_ms").select(_r("mean"), "peak", _r("total", 2), "samples")


def index_percentiles(spark, folder):
    return metrics.index_percentiles(_ops(spark, folder), "operation_type", "duration_ms").select("operation_type", "samples", "min", "max", _r("mean"), _r("deviation"), "p50", "p95", "p99")


def baseline_metrics(spark, folder):
    return metrics.baselines(_ops(spark, folder)).select("operation_type", "samples", _r("mean"), _r("deviation"), "p50", "p95", "p99", _r("success_rate"), _r("confidence"))


def baseline_stability(spark, folder):
    return metrics.stability(_ops(spark, folder), "operation_type", "duration_ms", _AT).select("operation_type", "samples", _r("cv_percent"), "stable")


def _halves(spark, folder):
    ops = _ops(spark, folder)
    early = F.col("event_id") % 2 == 0
    return metrics.baselines(ops.where(early)), metrics.baselines(ops.where(~early).withColumn("duration_ms", F.col("duration_ms") * F.when(F.col("operation_type") == "click", 1.6).otherwise(1.0)))


def regressions(spark, folder):
    base, now = _halves(spark, folder)
    return metrics.regressions(now, base).select("operation_type", "kind", _r("baseline_value"), _r("current_value"), _r("change_percent"), "severity")


def regression_report(spark, folder):
    base, now = _halves(spark, folder)
    return metrics.regression_report(metrics.regressions(now, base))


def linear_trend(spark, folder):
    return metrics.trend(_ops(spark, folder), "operation_type", "duration_ms", _AT).select("operation_type", "points", _r("slope"), "direction")


def trend_alerts(spark, folder):
    return metrics.trend_alerts(_ops(spark, folder), "operation_type", "duration_ms", _AT, slope=0.1, above=1.0).select("operation_type", _r("slope"), _r("mean"), "current")


def health_score(spark, folder):
    ops = _ops(spark, folder).withColumn("duration_ms", F.col("duration_ms") * 20)
    return metrics.health_score(metrics.average_metrics(ops), 75.0, 900.0, {"warning": 1}).select(_r("score"))


def recommendations(spark, folder):
    ops = _ops(spark, folder).withColumn("duration_ms", F.col("duration_ms") * 20)
    return metrics.recommendations(metrics.average_metrics(ops))


def memory_growth(spark, folder):
    return metrics.growth_runs(_ops(spark, folder), "user_id", "duration_ms", _AT)


def window_comparison(spark, folder):
    return metrics.window_comparison(_ops(spark, folder), "operation_type", "duration_ms", _AT).select("operation_type", _r("recent"), _r("before"), "trend")


def short_window_growth(spark, folder):
    return metrics.short_window_growth(_ops(spark, folder), "operation_type", "duration_ms", _AT).select("operation_type", _r("growth"), "leak")


def slow_share(spark, folder):
    return metrics.slow_share(_ops(spark, folder), 50.0).select("operation_type", _r("slow_share"))


def moving_average(spark, folder):
    return metrics.moving_average(_ops(spark, folder), "operation_type", "duration_ms", _AT, 0.2).select("operation_type", _r("average"))


def co_access(spark, folder):
    return metrics.co_access(_ops(spark, folder), "user_id", "operation_type", _AT)


def transitions(spark, folder):
    return metrics.transitions(_ops(spark, folder), "user_id", "operation_type", _AT)


def hour_histogram(spark, folder):
    return metrics.hour_histogram(_ops(spark, folder), "operation_type", "started_at")


def metric_rows(spark, folder):
    rows = metrics.metric_rows(_ops(spark, folder), "maintenance", F.col("event_id") % 50, F.col("duration_ms"), F.col("started_at"))
    return rows.groupBy("operation_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("items_processed").alias("items"), F.round(F.max("processing_rate"), 3).alias("best_rate"))


def progress(spark, folder):
    g = _ops(spark, folder).groupBy("operation_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 3 == 0).alias("done"))
    return g.select("operation_type", metrics.progress(F.col("total"), F.col("done"), F.lit(60)).alias("p")).select("operation_type", F.round("p.percent", 6).alias("percent"), F.round("p.rate", 6).alias("rate"), F.round("p.seconds_left", 6).alias("seconds_left"))


def adaptive_timeout(spark, folder):
    g = _ops(spark, folder).groupBy("operation_type").agg((F.avg("duration_ms") / 50).alias("f"), F.avg((F.col("duration_ms") > 100).cast("int")).alias("x"))
    return g.select("operation_type", F.round(metrics.adaptive_timeout(30000.0, F.col("f"), F.col("x")), 3).alias("timeout_ms"))


def _measured(spark, folder):
    """Operations with all their measures, derived from the events."""
    i = F.col("event_id")
    return _ops(spark, folder).withColumns({
        "items_processed": i % 50 + 1, "processing_rate": metrics.throughput(i % 50 + 1, F.col("duration_ms")), "memory_peak_mb": F.col("user_id") % 700 + i % 13, "cpu_usage_percent": i % 100,
        "bytes_read": i % 4096, "status": F.when(i % 17 == 0, "failed").otherwise("success"),
    })


def operation_averages(spark, folder):
    return metrics.average_metrics(_measured(spark, folder)).select(
        "operation_type", "operations", *[_r(f"mean_{c}") for c in ("duration_ms", "items_processed", "processing_rate", "memory_peak_mb", "cpu_usage_percent", "bytes_read")], _r("success_rate"))


def operation_trends(spark, folder):
    return metrics.hourly_trends(_measured(spark, folder), *_PERIOD).select("hour", "operation_type", "operations", *[_r(f"mean_{c}") for c in ("duration_ms", "processing_rate", "memory_peak_mb")])


def resource_period(spark, folder):
    return metrics.resource_summary(_measured(spark, folder), "memory_peak_mb", *_PERIOD).select(_r("mean"), "peak", "total", "samples")


def performance_report(spark, folder):
    return metrics.performance_report(_measured(spark, folder).withColumn("duration_ms", F.col("duration_ms") * 20), *_PERIOD).select("section", "subject", "measure", _r("value"), "note")


def resource_advice(spark, folder):
    used = _measured(spark, folder).agg((F.avg("cpu_usage_percent") + 40).alias("mean_cpu_percent"), F.max("memory_peak_mb").alias("peak_memory_mb"))
    return metrics.resource_advice(used)


def benchmark_summary(spark, folder):
    ops = _measured(spark, folder)
    early = F.col("event_id") % 2 == 0
    base = ops.where(early).groupBy("operation_type").agg(F.avg("duration_ms").alias("mean"))
    now = ops.where(~early).withColumn("duration_ms", F.col("duration_ms") * F.when(F.col("operation_type") == "click", 1.6).otherwise(1.0))
    return metrics.benchmark_summary(now, target_ms=60.0, baseline=base).select("operation_type", "samples", "min", "max", _r("mean"), "p50", "p95", _r("success_rate"), "target_met", "regression")


def benchmark_problems(spark, folder):
    return metrics.benchmark_problems(benchmark_summary(spark, folder))


def memory_regressions(spark, folder):
    ops = _measured(spark, folder)
    early = F.col("event_id") % 2 == 0
    side = lambda rows: metrics.baselines(rows).join(rows.groupBy("operation_type").agg(F.avg("memory_peak_mb").alias("memory")), "operation_type")
    now = side(ops.where(~early).withColumn("memory_peak_mb", F.col("memory_peak_mb") * F.when(F.col("operation_type") == "view", 1.4).otherwise(1.0)))
    return metrics.regressions(now, side(ops.where(early))).where("kind = 'memory'").select("operation_type", _r("baseline_value"), _r("current_value"), _r("change_percent"), "severity")


def memory_trend_alerts(spark, folder):
    """More than .1 MB a sample and 10 % above the mean of the last ten."""
    rows = _measured(spark, folder).withColumn("shelf", F.col("user_id") % 40)
    return metrics.trend_alerts(rows, "shelf", "memory_peak_mb", _AT, slope=0.1, above=1.1).select("shelf", _r("slope"), _r("mean"), "current")


def co_access_within_a_minute(spark, folder):
    return metrics.co_access(_ops(spark, folder).withColumn("shelf", (F.col("user_id") % 40).cast("string")), "shelf", "operation_type", _AT, 4, 60)


def eviction_by_policy(spark, folder):
    """What each policy would drop to keep a hundred users' entries."""
    now = F.lit(1_735_689_600)
    at = F.unix_timestamp("started_at")
    ops = _ops(spark, folder).withColumn("at", at)
    cache = ops.groupBy("user_id").agg((now - F.max("at")).alias("age"), F.count(F.lit(1)).alias("uses"), (F.min("at") + 86400 * 400 - now).alias("ttl_left")).join(caches.next_use(ops, "user_id", "at", now), "user_id")
    out = [caches.evicted(cache, p, 100, "user_id").select(F.lit(p).alias("policy"), "user_id") for p in ("lru", "lfu", "ttl", "blend", "predicted")]
    return reduce(lambda a, b: a.unionByName(b), out)


def memory_levels(spark, folder):
    return _ops(spark, folder).groupBy(metrics.memory_level(F.col("duration_ms"), 50, 100).alias("level")).agg(F.count(F.lit(1)).alias("samples"))


def history_latest(spark, folder):
    return _ops(spark, folder).orderBy(F.desc("started_at"), F.desc("event_id")).limit(100).select("event_id", "operation_type")


def queue_statistics(spark, folder):
    return load(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("requests"))


def request_deduplication(spark, folder):
    rows = _ops(spark, folder).select(F.col("event_id").alias("request_id"), "user_id", "started_at")
    return caches.deduplicated_requests(rows, ["user_id"], "started_at", 3600).select("request_id", "served_by")


def cache_expiry(spark, folder):
    rows = _ops(spark, folder).withColumn("cached_at", F.unix_timestamp("started_at"))
    now = F.unix_timestamp(F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("cached_at") <= now - 86400).alias("expired"))


def cache_relevance(spark, folder):
    r = caches.relevance(F.col("user_id") % 2 == 0, F.col("event_id") % 400, F.col("user_id"), F.lit(500), F.col("event_id") % 20 + 1)
    return load(spark, folder, "events").select("event_id", F.round(r, 6).alias("relevance"), caches.is_relevant(F.col("user_id") % 2 == 0, F.col("event_id") % 400, F.col("user_id") - 500, F.col("event_id") % 1500).alias("relevant"))


def eviction_order(spark, folder):
    s = caches.eviction_score(F.col("event_id") % 400, F.col("user_id") % 30)
    return load(spark, folder, "events").select("event_id", F.round(s, 9).alias("score"))


def dynamic_priority(spark, folder):
    e = load(spark, folder, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("suggestion", "search", "embedding", "analysis", "maintenance")]), (F.col("event_id") % 5 + 1).cast("int"))
    p = caches.priority(F.lit(2.0), F.col("value") / 100, F.col("event_id") % 10000, F.when(F.col("user_id") % 3 == 0, 2.0).otherwise(1.0), (F.col("user_id") % 10) / 10, kind, F.col("event_id") % 11 == 0)
    return e.select("event_id", F.round(p, 6).alias("priority"))


def session_activity(spark, folder):
    w = F.session_window("ts", "30 minutes")
    return load(spark, folder, "events").groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))


def paged_scan(spark, folder):
    return lookup.page(load(spark, folder, "part").select("p_partkey", "p_name"), 3, 50, "p_partkey")


def rollup_by_type_and_user_group(spark, folder):
    e = load(spark, folder, "events").withColumn("user_group", F.col("user_id") % 4)
    return e.rollup("event_type", "user_group").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))


def last_samples(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return load(spark, folder, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean_last_5"))


_OPS = "WITH o AS (SELECT event_id, event_type AS operation_type, ts AS started_at, value AS duration_ms, user_id FROM events)"
_PCT = """s AS (SELECT operation_type, list_sort(list(duration_ms)) AS l, count(*) AS samples, min(duration_ms) AS min, max(duration_ms) AS max, avg(duration_ms) AS mean, stddev_pop(duration_ms) AS deviation FROM {0} GROUP BY operation_type),
b{1} AS (SELECT *, l[samples * 50 // 100 + 1] AS p50, l[samples * 95 // 100 + 1] AS p95, l[samples * 99 // 100 + 1] AS p99, 1.0::DOUBLE AS success_rate FROM s)"""
_CONF = "least(1.0, samples / 50.0) * 0.3 + (1 - least(1.0, deviation / mean * 100 / 15.0)) * 0.4 + 1.0 * 0.3"
_REC = ", n AS (SELECT *, row_number() OVER (PARTITION BY operation_type ORDER BY started_at DESC, event_id DESC) AS n FROM o)"
_REG = _OPS + """, now AS (SELECT operation_type, duration_ms * CASE WHEN operation_type = 'click' THEN 1.6 ELSE 1.0 END AS d FROM o WHERE event_id % 2 = 1),
a AS (SELECT operation_type, avg(duration_ms) AS bm, stddev_pop(duration_ms) / avg(duration_ms) AS bc FROM o WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT operation_type, avg(d) AS m, stddev_pop(d) / avg(d) AS cv FROM now GROUP BY 1),
r AS (SELECT operation_type, 'latency' AS kind, bm AS baseline_value, m AS current_value, (m - bm) / bm * 100 AS change_percent FROM a JOIN c USING (operation_type) UNION ALL SELECT operation_type, 'stability', bc, cv, (cv - bc) / bc * 100 FROM a JOIN c USING (operation_type)),
f AS (SELECT *, CASE WHEN abs(change_percent) >= 100 THEN 'critical' WHEN abs(change_percent) >= 50 THEN 'major' WHEN abs(change_percent) >= 30 THEN 'moderate' ELSE 'minor' END AS severity FROM r WHERE change_percent > 20)"""

QUERIES = {f.__name__: f for f in (
    average_metrics, average_metrics_with_missing, hourly_trends, hourly_trends_from, resource_summary, index_percentiles, baseline_metrics, baseline_stability, regressions, regression_report, linear_trend,
    trend_alerts, health_score, recommendations, memory_growth, window_comparison, short_window_growth, slow_share, moving_average, co_access, transitions, hour_histogram, metric_rows, progress, adaptive_timeout,
    operation_averages, operation_trends, resource_period, performance_report, resource_advice, benchmark_summary, benchmark_problems, memory_regressions, memory_trend_alerts, co_access_within_a_minute,
    eviction_by_policy, memory_levels, history_latest, queue_statistics, request_deduplication, cache_expiry, cache_relevance, eviction_order, dynamic_priority, session_activity, paged_scan, rollup_by_type_and_user_group, last_samples,
)}
SQL = {
    "average_metrics": _OPS + " SELECT operation_type, count(*) AS operations, round(avg(duration_ms), 6) AS mean_duration_ms FROM o GROUP BY 1",
    "average_metrics_with_missing": _OPS + " SELECT operation_type, count(*) AS operations, round(avg(CASE WHEN event_id % 7 <> 0 THEN duration_ms ELSE 0 END), 6) AS mean_duration_ms FROM o GROUP BY 1",
    "hourly_trends": _OPS + " SELECT date_trunc('hour', started_at) AS hour, operation_type, count(*) AS operations, round(avg(duration_ms), 6) AS mean_duration_ms FROM o GROUP BY 1, 2",
    "hourly_trends_from": _OPS + " SELECT time_bucket(INTERVAL 1 HOUR, started_at, TIMESTAMP '2024-01-02 00:30:00') AS hour, operation_type, count(*) AS operations, round(avg(duration_ms), 6) AS mean_duration_ms FROM o WHERE started_at >= TIMESTAMP '2024-01-02 00:30:00' GROUP BY 1, 2",
    "resource_summary": "SELECT round(avg(value), 6) AS mean, max(value) AS peak, round(sum(value), 2) AS total, count(value) AS samples FROM events",
    "index_percentiles": _OPS + ", " + _PCT.format("o", "") + " SELECT operation_type, samples, min, max, round(mean, 6) AS mean, round(deviation, 6) AS deviation, p50, p95, p99 FROM b",
    "baseline_metrics": _OPS + ", " + _PCT.format("o", "") + f" SELECT operation_type, samples, round(mean, 6) AS mean, round(deviation, 6) AS deviation, p50, p95, p99, success_rate, round({_CONF}, 6) AS confidence FROM b",
    "baseline_stability": _OPS + _REC + " SELECT operation_type, count(*) AS samples, round(stddev_pop(duration_ms) / avg(duration_ms) * 100, 6) AS cv_percent, count(*) >= 5 AND stddev_pop(duration_ms) / avg(duration_ms) * 100 <= 15 AS stable FROM n WHERE n <= 5 GROUP BY 1",
    "regressions": _REG + " SELECT operation_type, kind, round(baseline_value, 6) AS baseline_value, round(current_value, 6) AS current_value, round(change_percent, 6) AS change_percent, severity FROM f",
    "regression_report": _REG + ", g AS (SELECT operation_type, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (severity = 'minor') AS minor FROM f GROUP BY 1) SELECT *, CASE WHEN critical > 0 THEN 'Critical' WHEN major > 0 THEN 'Poor' WHEN moderate > 0 THEN 'Fair' ELSE 'Good' END AS health FROM g",
    "linear_trend": _OPS + _REC + ", t AS (SELECT operation_type, count(*) AS points, regr_slope(duration_ms, -n) AS slope FROM n WHERE n <= 10 GROUP BY 1) SELECT operation_type, points, round(slope, 6) AS slope, CASE WHEN points < 3 THEN 'stable' WHEN slope > 0.1 THEN 'degrading' WHEN slope < -0.1 THEN 'improving' ELSE 'stable' END AS direction FROM t",
    "trend_alerts": _OPS + _REC + ", t AS (SELECT operation_type, regr_slope(duration_ms, -n) AS slope, avg(duration_ms) AS mean, max(duration_ms) FILTER (n = 1) AS current FROM n WHERE n <= 10 GROUP BY 1) SELECT operation_type, round(slope, 6) AS slope, round(mean, 6) AS mean, current FROM t WHERE t.slope > 0.1 AND current > t.mean",
    "health_score": _OPS + ", a AS (SELECT avg(duration_ms * 20) AS m FROM o GROUP BY operation_type) SELECT round(greatest(0, least(1, 1.0 - 0.2 - 0.05 * count(*) FILTER (m > 1000)))::DOUBLE, 6) AS score FROM a",
    "recommendations": _OPS + ", a AS (SELECT operation_type, avg(duration_ms * 20) AS m FROM o GROUP BY operation_type) SELECT operation_type, 'speed up ' || operation_type AS advice FROM a WHERE m > 1000 UNION ALL SELECT operation_type, 'split ' || operation_type FROM a WHERE m > 5000",
    "memory_growth": _OPS + ", g AS (SELECT *, CASE WHEN duration_ms > lag(duration_ms) OVER w THEN 1 ELSE 0 END AS up FROM o WINDOW w AS (PARTITION BY user_id ORDER BY started_at, event_id)), r AS (SELECT *, sum(1 - up) OVER (PARTITION BY user_id ORDER BY started_at, event_id) AS run FROM g), l AS (SELECT user_id, run, sum(up) AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest_growth, max(n) >= 3 AS leak FROM l GROUP BY 1",
    "window_comparison": _OPS + _REC + ", t AS (SELECT operation_type, avg(duration_ms) FILTER (n <= 10) AS recent, avg(duration_ms) FILTER (n > 10) AS before FROM n WHERE n <= 20 GROUP BY 1) SELECT operation_type, round(recent, 6) AS recent, round(before, 6) AS before, CASE WHEN t.recent > t.before * 1.1 THEN 'increasing' WHEN t.recent < t.before * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM t",
    "short_window_growth": _OPS + _REC + ", t AS (SELECT operation_type, arg_min(duration_ms, n) - arg_max(duration_ms, n) AS growth FROM n WHERE n <= 30 GROUP BY 1) SELECT operation_type, round(growth, 6) AS growth, t.growth > 50 AS leak FROM t",
    "slow_share": _OPS + " SELECT operation_type, round(avg(CASE WHEN duration_ms > 65 THEN 1 ELSE 0 END), 6) AS slow_share FROM o GROUP BY 1",
    "moving_average": _OPS + _REC + ", l AS (SELECT operation_type, list(duration_ms ORDER BY n DESC) AS v FROM n GROUP BY 1) SELECT operation_type, round(list_reduce(v, lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS average FROM l",
    "co_access": _OPS + ", p AS (" + " UNION ALL ".join(f"SELECT lag(operation_type, {k}) OVER (PARTITION BY user_id ORDER BY started_at, event_id) AS a, operation_type AS b FROM o" for k in (1, 2, 3, 4)) + ") SELECT a, b, count(*) AS times FROM p WHERE a IS NOT NULL AND a <> b GROUP BY 1, 2",
    "transitions": _OPS + ", p AS (SELECT lag(operation_type) OVER (PARTITION BY user_id ORDER BY started_at, event_id) AS previous, operation_type AS next FROM o) SELECT previous, next, count(*) AS times FROM p WHERE previous IS NOT NULL GROUP BY 1, 2",
    "hour_histogram": _OPS + " SELECT operation_type, hour(started_at) AS hour, count(*) AS accesses FROM o GROUP BY 1, 2",
    "metric_rows": "SELECT 'maintenance' AS operation_type, count(*) AS rows, sum(event_id % 50) AS items, round(max(CASE WHEN value > 0 THEN (event_id % 50) / (value / 1000) ELSE 0 END), 3) AS best_rate FROM events",
    "progress": _OPS + ", g AS (SELECT operation_type, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS done FROM o GROUP BY 1) SELECT operation_type, round(done * 100.0 / total, 6)::DOUBLE AS percent, round(done / 60, 6) AS rate, CASE WHEN done > 0 THEN round((total - done) / (done / 60), 6) END AS seconds_left FROM g",
    "adaptive_timeout": _OPS + ", g AS (SELECT operation_type, avg(duration_ms) / 50 AS f, avg(CASE WHEN duration_ms > 100 THEN 1 ELSE 0 END) AS x FROM o GROUP BY 1) SELECT operation_type, round(greatest(15000.0::DOUBLE, least(90000.0::DOUBLE, 30000.0::DOUBLE * f * (1 + x))), 3) AS timeout_ms FROM g",
    "memory_levels": "SELECT CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'normal' END AS level, count(*) AS samples FROM events GROUP BY 1",
    "history_latest": "SELECT event_id, event_type AS operation_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "queue_statistics": "SELECT o_orderpriority, count(*) AS requests FROM orders GROUP BY 1",
    "request_deduplication": "WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM n) SELECT event_id AS request_id, first_value(event_id) OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS served_by FROM b",
    "cache_expiry": "SELECT count(*) AS entries, count(*) FILTER (floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-05 00:00:00') - 86400) AS expired FROM events",
    "cache_relevance": "WITH x AS (SELECT event_id, user_id, event_id % 400 AS age, event_id % 20 + 1 AS uses FROM events) SELECT event_id, round(CASE WHEN user_id % 2 = 0 THEN greatest(0, least(1, (CASE WHEN age > 300 THEN 0 ELSE 1 - age / 300 END) * (CASE WHEN user_id = 0 THEN 0.5 ELSE least(user_id, 500) / greatest(user_id, 500) END) * least(1.5, 1 + log10(uses) * 0.1))) ELSE 0 END::DOUBLE, 6) AS relevance, user_id % 2 = 0 AND age <= 300 AND abs(user_id - 500) < 500 AND event_id % 1500 < 1000 AS relevant FROM x",
    "eviction_order": "SELECT event_id, round(0.6::DOUBLE / (1 + event_id % 400) + 0.4::DOUBLE * (user_id % 30) / (1 + user_id % 30), 9) AS score FROM events",
    "dynamic_priority": "WITH x AS (SELECT *, CASE WHEN value / 100 > 0.7 THEN 1.5 WHEN event_id % 10000 < 5000 THEN 1.2 ELSE 1.0 END AS a, CASE WHEN user_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS r, CASE WHEN user_id % 10 > 8 THEN 0.7 WHEN user_id % 10 < 5 THEN 1.1 ELSE 1.0 END AS s, [1.2, 1.1, 1.0, 0.9, 0.8][event_id % 5 + 1] AS k FROM events) SELECT event_id, round((2.0 * (a * 0.3 + r * 0.3 + s * 0.2 + k * 0.2) * CASE WHEN event_id % 11 = 0 THEN 2.0 ELSE 1.0 END)::DOUBLE, 6) AS priority FROM x",
    "session_activity": "WITH n AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n), c AS (SELECT count(*) AS n FROM s GROUP BY user_id, s) SELECT n, count(*) AS sessions FROM c GROUP BY n",
    "paged_scan": "SELECT p_partkey, p_name, (SELECT count(*) FROM part) > 200 AS has_more FROM part ORDER BY p_partkey LIMIT 50 OFFSET 150",
    "rollup_by_type_and_user_group": "SELECT event_type, user_id % 4 AS user_group, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 4)",
    "last_samples": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_last_5 FROM events",
}
_MEAS = """WITH o AS (SELECT event_id, event_type AS operation_type, ts AS started_at, value AS duration_ms, user_id, event_id % 50 + 1 AS items_processed, CASE WHEN value > 0 THEN (event_id % 50 + 1) / (value / 1000) ELSE 0 END AS processing_rate,
  user_id % 700 + event_id % 13 AS memory_peak_mb, event_id % 100 AS cpu_usage_percent, event_id % 4096 AS bytes_read, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS ok FROM events),
p AS (SELECT * FROM o WHERE started_at >= TIMESTAMP '2024-01-02 00:30:00' AND started_at <= TIMESTAMP '2024-02-15 00:00:00')"""
_AVG = "count(*) AS operations, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("duration_ms", "items_processed", "processing_rate", "memory_peak_mb", "cpu_usage_percent", "bytes_read")) + ", round(avg(ok), 6) AS success_rate"
_SUMMARY = _MEAS + """, b AS (SELECT operation_type, avg(duration_ms) AS bm FROM o WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT operation_type, duration_ms * CASE WHEN operation_type = 'click' THEN 1.6 ELSE 1.0 END AS d, ok FROM o WHERE event_id % 2 = 1),
s AS (SELECT operation_type, list_sort(list(d)) AS l, count(*) AS samples, min(d) AS min, max(d) AS max, avg(d) AS mean, avg(ok) AS success_rate FROM n GROUP BY 1),
r AS (SELECT operation_type, samples, min, max, mean, l[samples * 50 // 100 + 1] AS p50, l[samples * 95 // 100 + 1] AS p95, success_rate, mean <= 60 AS target_met, mean > bm * 1.2 AS regression FROM s JOIN b USING (operation_type))"""
_CACHE = """WITH c AS (SELECT user_id, 1735689600 - max(floor(epoch(ts)))::BIGINT AS age, count(*) AS uses, min(floor(epoch(ts)))::BIGINT + 86400 * 400 - 1735689600 AS ttl,
  CASE WHEN count(*) > 1 THEN greatest(0, max(floor(epoch(ts))) + (max(floor(epoch(ts))) - min(floor(epoch(ts)))) / (count(*) - 1) - 1735689600) END AS due FROM events GROUP BY user_id),
s AS (SELECT user_id, unnest([{'p': 'lru', 's': -age::DOUBLE}, {'p': 'lfu', 's': uses::DOUBLE}, {'p': 'ttl', 's': ttl::DOUBLE}, {'p': 'blend', 's': 0.6::DOUBLE / (1 + age) + 0.4::DOUBLE * uses / (1 + uses)}, {'p': 'predicted', 's': coalesce(-due, '-inf'::DOUBLE)}]) AS x FROM c)"""
SQL |= {
    "operation_averages": _MEAS + f" SELECT operation_type, {_AVG} FROM o GROUP BY 1",
    "operation_trends": _MEAS + " SELECT time_bucket(INTERVAL 1 HOUR, started_at, TIMESTAMP '2024-01-02 00:30:00') AS hour, operation_type, count(*) AS operations, round(avg(duration_ms), 6) AS mean_duration_ms, round(avg(processing_rate), 6) AS mean_processing_rate, round(avg(memory_peak_mb), 6) AS mean_memory_peak_mb FROM p GROUP BY 1, 2",
    "resource_period": _MEAS + " SELECT round(avg(memory_peak_mb), 6) AS mean, max(memory_peak_mb) AS peak, CAST(sum(memory_peak_mb) AS BIGINT) AS total, count(*) AS samples FROM p",
    "performance_report": _MEAS + """, q AS (SELECT * REPLACE (duration_ms * 20 AS duration_ms) FROM p), a AS (SELECT operation_type AS subject, count(*)::DOUBLE AS operations, avg(duration_ms) AS mean_duration_ms, avg(items_processed) AS mean_items_processed, avg(processing_rate) AS mean_processing_rate,
          avg(memory_peak_mb) AS mean_memory_peak_mb, avg(cpu_usage_percent) AS mean_cpu_usage_percent, avg(bytes_read) AS mean_bytes_read, avg(ok) AS success_rate FROM q GROUP BY 1),
        u AS (SELECT avg(cpu_usage_percent) AS mean_cpu_percent, max(memory_peak_mb)::DOUBLE AS peak_memory_mb, count(*)::DOUBLE AS operations FROM q),
        m AS (SELECT 'operations' AS section, subject, measure, value FROM (UNPIVOT a ON COLUMNS(* EXCLUDE subject) INTO NAME measure VALUE value) UNION ALL SELECT 'resources', 'all', measure, value FROM (UNPIVOT u ON COLUMNS(*) INTO NAME measure VALUE value)
          UNION ALL SELECT 'health', 'all', 'score', greatest(0, least(1, 1 - CASE WHEN (SELECT mean_cpu_percent FROM u) > 70 THEN 0.1 ELSE 0 END - CASE WHEN (SELECT peak_memory_mb FROM u) > 1000 THEN 0.1 ELSE 0 END - 0.05 * count(*) FILTER (mean_duration_ms > 1000)))::DOUBLE FROM a),
        n AS (SELECT subject, 'speed up ' || subject AS note FROM a WHERE mean_duration_ms > 1000 UNION ALL SELECT subject, 'split ' || subject FROM a WHERE mean_duration_ms > 5000 UNION ALL SELECT 'all', 'make batches smaller' FROM u WHERE peak_memory_mb > 500 UNION ALL SELECT 'all', 'run fewer tasks at once' FROM u WHERE mean_cpu_percent > 80)
        SELECT section, subject, measure, round(value, 6) AS value, NULL::VARCHAR AS note FROM m UNION ALL SELECT 'advice', subject, 'advice', NULL, note FROM n""",
    "resource_advice": _MEAS + ", u AS (SELECT avg(cpu_usage_percent) + 40 AS c, max(memory_peak_mb) AS m FROM o) SELECT 'make batches smaller' AS advice FROM u WHERE m > 500 UNION ALL SELECT 'run fewer tasks at once' FROM u WHERE c > 80",
    "benchmark_summary": _SUMMARY + " SELECT * REPLACE (round(mean, 6) AS mean, round(success_rate, 6) AS success_rate) FROM r",
    "benchmark_problems": _SUMMARY + " SELECT operation_type, 'regression' AS problem FROM r WHERE regression UNION ALL SELECT operation_type, 'target missed' FROM r WHERE NOT target_met UNION ALL SELECT operation_type, 'low success' FROM r WHERE success_rate < 0.95",
    "memory_regressions": _MEAS + """, g AS (SELECT operation_type, avg(memory_peak_mb) FILTER (event_id % 2 = 0) AS b, avg(memory_peak_mb * CASE WHEN operation_type = 'view' THEN 1.4 ELSE 1.0 END) FILTER (event_id % 2 = 1) AS c FROM o GROUP BY 1), h AS (SELECT *, (c - b) / b * 100 AS x FROM g)
        SELECT operation_type, round(b, 6) AS baseline_value, round(c, 6) AS current_value, round(x, 6) AS change_percent, CASE WHEN x >= 100 THEN 'critical' WHEN x >= 50 THEN 'major' WHEN x >= 30 THEN 'moderate' ELSE 'minor' END AS severity FROM h WHERE x > 20""",
    "memory_trend_alerts": _MEAS + ", n AS (SELECT *, user_id % 40 AS shelf, row_number() OVER (PARTITION BY user_id % 40 ORDER BY started_at DESC, event_id DESC) AS n FROM o), t AS (SELECT shelf, regr_slope(memory_peak_mb, -n) AS slope, avg(memory_peak_mb) AS mean, max(memory_peak_mb) FILTER (n = 1) AS current FROM n WHERE n <= 10 GROUP BY 1) SELECT shelf, round(slope, 6) AS slope, round(mean, 6) AS mean, current FROM t WHERE t.slope > 0.1 AND current > t.mean * 1.1",
    "co_access_within_a_minute": _OPS + ", p AS (" + " UNION ALL ".join(f"SELECT lag(operation_type, {k}) OVER w AS a, operation_type AS b, epoch_us(started_at) - epoch_us(lag(started_at, {k}) OVER w) AS d FROM o WINDOW w AS (PARTITION BY user_id % 40 ORDER BY started_at, event_id)" for k in (1, 2, 3, 4)) + ") SELECT a, b, count(*) AS times FROM p WHERE a <> b AND d <= 60000000 GROUP BY 1, 2",
    "eviction_by_policy": _CACHE + " SELECT x.p AS policy, user_id FROM s QUALIFY row_number() OVER (PARTITION BY x.p ORDER BY x.s DESC, user_id) > 100",
}
SQL["memory_growth"] = as_bigint(SQL["memory_growth"], "longest_growth")
SQL["metric_rows"] = as_bigint(SQL["metric_rows"], "items")
