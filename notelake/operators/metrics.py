"""Operation metrics: averages, trends, percentiles, baselines, regressions, health, memory growth."""

from __future__ import annotations

import statistics
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators import ordered
from notelake.session import written


#: What operations may carry besides their duration; means are taken of those that are there.
MEASURES = ("items_processed", "processing_rate", "memory_peak_mb", "cpu_usage_percent", "io_operations", "bytes_read", "bytes_written")


def _means(ops: DataFrame, *names: str) -> list[Column]:
    return [F.avg(c).alias(f"mean_{c}") for c in names or MEASURES if c in ops.columns]


def average_metrics(ops: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Per operation type: count, mean duration and the means of the other measures that the rows carry, and the share of successes where there is
    a ``status``. Rows without a duration are left out of its mean, or count as 0."""
    d = F.coalesce("duration_ms", F.lit(0.0)) if missing_as_zero else F.col("duration_ms")
    rate = [F.avg((F.col("status") == "success").cast("int")).alias("success_rate")] if "status" in ops.columns else []
    return ops.groupBy("operation_type").agg(F.count(F.lit(1)).alias("operations"), F.avg(d).alias("mean_duration_ms"), *_means(ops), *rate)


def in_period(rows: DataFrame, start: str | None, end: str | None, at: str = "started_at") -> DataFrame:
    """Rows from ``start`` to ``end`` (timestamp texts, both inclusive; None: no limit)."""
    for limit, keep in ((start, F.col(at).__ge__), (end, F.col(at).__le__)):
        rows = rows if limit is None else rows.where(keep(F.lit(limit).cast("timestamp")))
    return rows


def hourly_trends(ops: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per hour and type: count, mean duration, and mean rate and memory where the rows carry them. Hours are whole ones, or begin at ``start`` (a timestamp text) and its successors."""
    if start is None:
        hour = F.date_trunc("hour", "started_at")
    else:
        begin = F.unix_timestamp(F.lit(start).cast("timestamp"))
        hour = F.timestamp_seconds(begin + F.floor((F.unix_timestamp("started_at") - begin) / 3600) * 3600)
    rows = in_period(ops, start, end)
    return rows.groupBy(hour.alias("hour"), "operation_type").agg(F.count(F.lit(1)).alias("operations"), F.avg("duration_ms").alias("mean_duration_ms"), *_means(ops, "processing_rate", "memory_peak_mb"))


def resource_summary(samples: DataFrame, column: str, start: str | None = None, end: str | None = None, at: str = "started_at") -> DataFrame:
    """Mean, peak, sum and number of the samples of a period."""
    return in_period(samples, start, end, at).agg(F.avg(column).alias("mean"), F.max(column).alias("peak"), F.sum(column).alias("total"), F.count(column).alias("samples"))


def performance_report(ops: DataFrame, start: str | None, end: str | None, memory: str = "memory_peak_mb", cpu: str = "cpu_usage_percent", alerts: dict[str, int] | None = None) -> DataFrame:
    """(section, subject, measure, value, note) of a period: averages per type, resources, advice and the health score in one table."""
    rows = in_period(ops, start, end)
    averages = average_metrics(rows)
    names = [c for c in averages.columns if c != "operation_type"]
    each = averages.select(F.lit("operations").alias("section"), F.col("operation_type").alias("subject"), F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("m"))
    out = each.select("section", "subject", "m.measure", "m.value", F.lit(None).cast("string").alias("note"))
    used = rows.agg(F.avg(cpu).alias("mean_cpu_percent"), F.max(memory).alias("peak_memory_mb"), F.count(F.lit(1)).cast("double").alias("operations"))
    for c in used.columns:
        out = out.unionByName(used.select(F.lit("resources").alias("section"), F.lit("all").alias("subject"), F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("note")))
    both = averages.join(used.select("mean_cpu_percent", "peak_memory_mb"), how="cross")  # one row
    advice = recommendations(averages).select("operation_type", "advice").unionByName(resource_advice(used).select(F.lit("all").alias("operation_type"), "advice"))
    out = out.unionByName(advice.select(F.lit("advice").alias("section"), F.col("operation_type").alias("subject"), F.lit("advice").alias("measure"), F.lit(None).cast("double").alias("value"), F.col("advice").alias("note")))
    score = both.agg(health(F.count_if(F.col("mean_duration_ms") > 1000), F.max("mean_cpu_percent"), F.max("peak_memory_mb"), alerts).alias("value"))
    return out.unionByName(score.select(F.lit("health").alias("section"), F.lit("all").alias("subject"), F.lit("score").alias("measure"), "value", F.lit(None).cast("string").alias("note")))


def index_percentiles(ops: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99), slices: int = 64) -> DataFrame:
    """Count, min, max, mean, population deviation, and sorted[n * p / 100] for each p (not the same as percentile_disc). Null groups are one group.

    Exact and distributed: equal values are counted first (map-side); the distinct values of a group are cut into slices of about equal
    size by approximate quantiles, each slice is sorted by itself and knows how many rows the slices before it hold. So a group
    that has a third of all rows is sorted by as many tasks as it has slices.
    """
    counts = written(ops.where(F.col(value).isNotNull()).groupBy(F.struct(by).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "values")
    steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    edges = counts.groupBy("g").agg(F.percentile_approx("v", steps, 10 * slices).alias("edges"))
    cut = counts.join(edges, "g").select("g", "v", "c", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("slice"))
    sizes = cut.groupBy("g", "slice").agg(F.sum("c").alias("rows"))
    w = Window.partitionBy("g")
    starts = sizes.select("g", "slice", (F.sum("rows").over(w.orderBy("slice")) - F.col("rows")).alias("before"), F.sum("rows").over(w).alias("n"))  # at most groups x slices rows
    placed = cut.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "slice").orderBy("v"))).join(starts, ["g", "slice"])
    picks = [F.min(F.when(F.col("before") + F.col("upto") > F.floor(F.col("n") * p / 100), F.col("v"))).alias(f"p{p}") for p in percents]
    stats = ops.groupBy(F.struct(by).alias("g")).agg(F.count(value).alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return stats.join(placed.groupBy("g").agg(*picks), "g", "left").select(F.col(f"g.{by}").alias(by), *[c for c in stats.columns if c != "g"], *[f"p{p}" for p in percents])


def stability(ops: DataFrame, by: str, value: str, at: list[str], last: int = 5, most_cv: float = 15.0) -> DataFrame:
    """Coefficient of variation (percent) of the last samples per group, and whether it is small enough."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    recent = ops.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    cv = F.stddev_pop(value) / F.avg(value) * 100
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), cv.alias("cv_percent")).withColumn("stable", (F.col("samples") >= last) & (F.col("cv_percent") <= most_cv))


def confidence(samples: Column, cv_percent: Column, success_rate: Column, most_samples: int = 50, most_cv: float = 15.0) -> Column:
    """0.3 x samples / 50 + 0.4 x (1 - cv / 15) + 0.3 x success, each factor within 0..1."""
    return F.least(F.lit(1.0), samples / most_samples) * 0.3 + (1 - F.least(F.lit(1.0), cv_percent / most_cv)) * 0.4 + success_rate * 0.3


def baselines(ops: DataFrame, by: str = "operation_type", value: str = "duration_ms") -> DataFrame:
    """Baseline of each operation: percentiles, deviation and confidence (every row counts as a success if it has a duration)."""
    p = index_percentiles(ops, by, value)
    rate = ops.groupBy(by).agg((F.count(value) / F.count(F.lit(1))).alias("success_rate"))
    return p.join(rate, by).withColumn("confidence", confidence(F.col("samples"), F.col("deviation") / F.col("mean") * 100, F.col("success_rate")))


def severity(change_percent: Column) -> Column:
    """Critical from 100 %, major from 50, moderate from 30, else minor."""
    c = F.abs(change_percent)
    return F.when(c >= 100, "critical").when(c >= 50, "major").when(c >= 30, "moderate").otherwise("minor")


def regressions(current: DataFrame, baseline: DataFrame, by: str = "operation_type", threshold: float = 20.0) -> DataFrame:
    """(by, kind, baseline_value, current_value, change_percent, severity) where current is worse than the baseline by more than the threshold.

    Kinds: latency (mean), memory (``memory``, where both sides have it), success, stability (deviation over mean). Both sides as :func:`baselines`
    gives them; operations without a baseline have none.
    """
    memory = "memory" in current.columns and "memory" in baseline.columns
    b = baseline.select(by, *[F.col(c).alias(f"base_{c}") for c in ("mean", "deviation", "success_rate", *["memory"] * memory)])
    j = current.join(b, by)
    change = lambda now, then: (now - then) / then * 100
    cv, base_cv = F.col("deviation") / F.col("mean"), F.col("base_deviation") / F.col("base_mean")
    rate, base_rate = F.col("success_rate"), F.col("base_success_rate")
    kinds = [("latency", F.col("base_mean"), F.col("mean"), change(F.col("mean"), F.col("base_mean"))), ("stability", base_cv, cv, change(cv, base_cv)), ("success", base_rate, rate, -change(rate, base_rate))]
    if memory:
        kinds.append(("memory", F.col("base_memory"), F.col("memory"), change(F.col("memory"), F.col("base_memory"))))
    rows = F.stack(F.lit(len(kinds)), *[x for k, *values in kinds for x in (F.lit(k), *values)])
    found = j.select(by, rows.alias("kind", "baseline_value", "current_value", "change_percent")).where(F.col("change_percent") > threshold)
    return found.withColumn("severity", severity(F.col("change_percent")))


def benchmark_summary(ops: DataFrame, by: str = "operation_type", value: str = "duration_ms", target_ms: float = 100.0, baseline: DataFrame | None = None, slower: float = 20.0) -> DataFrame:
    """Per operation: samples, min, max, mean, sorted[n / 2], sorted[95 n / 100], success rate (``status``, else rows with a duration), whether the mean meets the
    target, and whether it is more than ``slower`` percent above the mean of ``baseline`` (by, mean; none: never)."""
    ok = F.col("status") == "success" if "status" in ops.columns else F.col(value).isNotNull()
    rate = ops.groupBy(F.struct(by).alias("g")).agg(F.avg(ok.cast("int")).alias("success_rate"))
    p = index_percentiles(ops, by, value, (50, 95)).withColumn("g", F.struct(by)).join(rate, "g").drop("g", "deviation")
    p = p.withColumn("target_met", F.col("mean") <= target_ms)
    if baseline is None:
        return p.withColumn("regression", F.lit(False))
    return p.join(baseline.select(by, F.col("mean").alias("_mean")), by, "left").withColumn("regression", F.coalesce(F.col("mean") > F.col("_mean") * (1 + slower / 100), F.lit(False))).drop("_mean")


def benchmark_problems(summary: DataFrame, by: str = "operation_type", least_success: float = 0.95) -> DataFrame:
    """(by, problem) of a :func:`benchmark_summary`: regression, target missed, low success; a row for each."""
    found = F.array(F.when(F.col("regression"), "regression"), F.when(~F.col("target_met"), "target missed"), F.when(F.col("success_rate") < least_success, "low success"))
    return summary.select(by, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def regression_report(found: DataFrame, by: str = "operation_type") -> DataFrame:
    """Regressions per operation and severity, and the overall state."""
    n = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "moderate", "minor")]
    state = F.when(F.col("critical") > 0, "Critical").when(F.col("major") > 0, "Poor").when(F.col("moderate") > 0, "Fair").otherwise("Good")
    return found.groupBy(by).agg(*n).withColumn("health", state)


def trend(points: DataFrame, by: str, value: str, at: list[str], last: int = 10, limit: float = 0.1, rising_is_good: bool = False) -> DataFrame:
    """Least-squares slope of the last points per group, oldest first, and its direction. Fewer than 3 points are stable."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    recent = points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    out = recent.groupBy(by).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(F.col(value), (-F.col("_n")).cast("double")).alias("slope"))
    up, down = ("improving", "degrading") if rising_is_good else ("degrading", "improving")
    return out.withColumn("direction", F.when((F.col("points") < 3) | F.col("slope").isNull(), "stable").when(F.col("slope") > limit, up).when(F.col("slope") < -limit, down).otherwise("stable"))


def trend_alerts(points: DataFrame, by: str, value: str, at: list[str], last: int = 10, slope: float = 0.5, above: float = 1.1) -> DataFrame:
    """Groups whose last value is more than 10 % above the mean of the recent ones while their slope is above ``slope``."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    recent = points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    out = recent.groupBy(by).agg(F.regr_slope(F.col(value), (-F.col("_n")).cast("double")).alias("slope"), F.avg(value).alias("mean"), F.max(F.when(F.col("_n") == 1, F.col(value))).alias("current"))
    return out.where((F.col("slope") > slope) & (F.col("current") > F.col("mean") * above))


def health(slow: Column, mean_cpu: Column, peak_memory_mb: Column, alerts: dict[str, int] | None = None) -> Column:
    """1 less 0.1 for CPU above 70 %, 0.1 for memory above 1000 MB, 0.05 per slow operation and per alert 0.2, 0.1 or 0.05; within 0..1."""
    fixed = float(sum({"critical": 0.2, "warning": 0.1, "info": 0.05}[k] * n for k, n in (alerts or {}).items()))
    less = F.when(mean_cpu > 70, 0.1).otherwise(0.0) + F.when(peak_memory_mb > 1000, 0.1).otherwise(0.0) + F.lit(fixed) + slow * 0.05
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - less))


def health_score(averages: DataFrame, mean_cpu: float, peak_memory_mb: float, alerts: dict[str, int] | None = None) -> DataFrame:
    """:func:`health` of averages by type, those over 1000 ms being slow."""
    return averages.agg(health(F.count_if(F.col("mean_duration_ms") > 1000), F.lit(mean_cpu), F.lit(peak_memory_mb), alerts).alias("score"))


#: Milliseconds that operations of a type may take on the mean.
TARGETS_MS = {"incremental_update": 100.0, "maintenance": 5000.0, "rebuilding": 30_000.0}


def recommendations(averages: DataFrame) -> DataFrame:
    """One row per advice: slow operation types (over 1000 ms), very slow ones (over 5000 ms), and types over their own target (a rebuild only if it had
    fewer than 1000 items on the mean, where that is known)."""
    d, kind = F.col("mean_duration_ms"), F.lower("operation_type")
    late = F.lit(False)
    for name, most in TARGETS_MS.items():
        few = F.col("mean_items_processed") < 1000 if name == "rebuilding" and "mean_items_processed" in averages.columns else F.lit(True)
        late = late | ((kind == name) & (d > most) & few)
    advice = F.array(F.when(d > 1000, F.concat(F.lit("speed up "), "operation_type")), F.when(d > 5000, F.concat(F.lit("split "), "operation_type")), F.when(late, F.concat("operation_type", F.lit(" misses its target"))))
    return averages.select("operation_type", F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("advice"))


def resource_advice(used: DataFrame, most_memory_mb: float = 500.0, most_cpu_percent: float = 80.0) -> DataFrame:
    """(advice) from (mean_cpu_percent, peak_memory_mb): smaller batches above 500 MB, fewer tasks at once above 80 % CPU."""
    advice = F.array(F.when(F.col("peak_memory_mb") > most_memory_mb, "make batches smaller"), F.when(F.col("mean_cpu_percent") > most_cpu_percent, "run fewer tasks at once"))
    return used.select(F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("advice"))


def index_health(entries: int, files: int, size_bytes: int) -> dict[str, object]:
    """Fragmentation (files against one per 1000 entries, percent), efficiency (4096 bytes a row are ideal), density per MB, status."""
    ideal = max(1, entries // 1000)
    fragmentation = min(100.0, max(0.0, (files - ideal) / ideal * 100))
    efficiency = max(0.1, min(1.0, 4096 * entries / size_bytes)) if entries and size_bytes else 1.0
    density = entries / (size_bytes / 1_048_576) if size_bytes else 0.0
    status = "critical" if fragmentation > 50 or efficiency < 0.5 else "warning" if fragmentation > 25 or efficiency < 0.7 else "healthy"
    actions = (["compact"] if fragmentation > 25 else []) + (["compress", "deduplicate"] if efficiency < 0.7 else [])
    return {"fragmentation_percent": fragmentation, "efficiency": efficiency, "density": density, "status": status, "actions": actions}


def growth_runs(samples: DataFrame, by: str, value: str, at: list[str], least: int = 3) -> DataFrame:
    """Longest run of consecutive growths per group, and whether it is a suspected leak. Ties in time are settled by the rest of ``at``.

    A run lies between two rows that didn't grow; the gaps between the positions of these are its length.
    """
    cut = ordered.numbered(ordered.preceding(ordered.in_slices(samples.select(by, value, *at), [by], at[0]), at, F.col(value), 1), at)
    grown = F.coalesce(F.col(value) > F.get("_before", F.lit(0))["v"], F.lit(False))
    stops = written(cut.select("_g", "_slice", "_position", (~grown).alias("_stop")), "positions")
    gaps = ordered.preceding(stops.where("_stop"), ["_position"], F.col("_position"), 1).select("_g", (F.col("_position") - F.get("_before", F.lit(0))["v"] - 1).alias("n"), "_position")
    longest = gaps.groupBy("_g").agg(F.max("n").alias("inside"), F.max("_position").alias("last")).join(stops.groupBy("_g").agg(F.max("_position").alias("rows")), "_g")
    run = F.greatest(F.coalesce("inside", F.lit(0)), F.col("rows") - F.col("last"))
    return longest.select(F.col(f"_g.{by}").alias(by), run.cast("long").alias("longest_growth")).withColumn("leak", F.col("longest_growth") >= least)


def window_comparison(samples: DataFrame, by: str, value: str, at: list[str], size: int = 10) -> DataFrame:
    """Mean of the last samples against the ones before, with its direction (more than 10 % either way)."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    n = samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * size)
    out = n.groupBy(by).agg(F.avg(F.when(F.col("_n") <= size, F.col(value))).alias("recent"), F.avg(F.when(F.col("_n") > size, F.col(value))).alias("before"))
    return out.withColumn("trend", F.when(F.col("recent") > F.col("before") * 1.1, "increasing").when(F.col("recent") < F.col("before") * 0.9, "decreasing").otherwise("stable"))


def short_window_growth(samples: DataFrame, by: str, value: str, at: list[str], size: int = 30, limit: float = 50.0) -> DataFrame:
    """Newest minus oldest of the last samples, and whether it is above the limit."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    n = samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
    out = n.groupBy(by).agg((F.max_by(value, -F.col("_n")) - F.max_by(value, "_n")).alias("growth"))
    return out.withColumn("leak", F.col("growth") > limit)


def slow_share(ops: DataFrame, target: float, by: str = "operation_type") -> DataFrame:
    """Share of operations more than 30 % above the target."""
    return ops.groupBy(by).agg(F.avg((F.col("duration_ms") > target * 1.3).cast("int")).alias("slow_share"))


def moving_average(ops: DataFrame, by: str, value: str, at: list[str], alpha: float) -> DataFrame:
    """Exponential moving average after the last value per group, begun with its first one; null values are passed over.

    The sum of all values, each weighted by alpha (1 - alpha)^(values after it), the first one without alpha; summed slice by
    slice, each sum then aged by the values of the later slices.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    cut = ordered.in_slices(ops.where(F.col(value).isNotNull()).select(by, *at, F.col(value).cast("double").alias("_v")), [by], at[0])
    w = Window.partitionBy("_g", "_slice")
    after = F.row_number().over(w.orderBy(*[F.desc(c) for c in at])) - 1
    aged = lambda n: F.when(n == 0, 1.0).otherwise(F.pow(F.lit(1.0 - alpha), n))
    placed = cut.withColumn("_after", after)
    sums = placed.groupBy("_g", "_slice").agg(F.sum(F.col("_v") * alpha * aged(F.col("_after"))).alias("_sum"), F.max_by("_v", "_after").alias("_oldest"), F.count(F.lit(1)).alias("_rows"))  # groups x slices rows
    g = Window.partitionBy("_g")
    later = F.coalesce(F.sum("_rows").over(g.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = F.when(F.col("_slice") == F.min("_slice").over(g), F.col("_oldest") * (1 - alpha) * aged(F.col("_rows") - 1)).otherwise(F.lit(0.0))
    each = sums.select("_g", ((F.col("_sum") + begun) * aged(later)).alias("_part"))
    return each.groupBy("_g").agg(F.sum("_part").alias("average")).select(F.col(f"_g.{by}").alias(by), "average")


def throughput(items: Column, milliseconds: Column) -> Column:
    return F.when(milliseconds > 0, items / (milliseconds / 1000)).otherwise(F.lit(0.0))


def co_access(accesses: DataFrame, by: str, item: str, at: list[str], within: int = 4, seconds: float | None = None) -> DataFrame:
    """How often two items are used within a few accesses of each other, per pair (the earlier first); with ``seconds``, only where the first of ``at``, a
    timestamp, lies no further apart."""
    rows = ordered.preceding(ordered.in_slices(accesses.select(by, item, *[c for c in at if c not in (by, item)]), [by], at[0]), at, F.struct(F.col(item).alias("item"), F.col(at[0]).alias("at")), within)
    seen = F.col("_before")
    if seconds is not None:
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        seen = F.filter("_before", lambda x: micros(F.col(at[0])) - micros(x["v"]["at"]) <= int(seconds * 1_000_000))
    pairs = rows.select(F.explode(F.transform(seen, lambda x: x["v"]["item"])).alias("a"), F.col(item).alias("b"))
    return pairs.where("a is not null and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def transitions(accesses: DataFrame, by: str, item: str, at: list[str]) -> DataFrame:
    """How often one item follows another."""
    rows = ordered.preceding(ordered.in_slices(accesses.select(by, item, *[c for c in at if c not in (by, item)]), [by], at[0]), at, F.col(item), 1)
    return rows.select(F.get("_before", F.lit(0))["v"].alias("previous"), F.col(item).alias("next")).where("previous is not null").groupBy("previous", "next").agg(F.count(F.lit(1)).alias("times"))


def hour_histogram(accesses: DataFrame, item: str, at: str) -> DataFrame:
    return accesses.groupBy(item, F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("accesses"))


def metric_rows(ops: DataFrame, kind: str, items: Column, duration: Column, at: Column) -> DataFrame:
    """Statistics of any job in the common metric schema; unite several with unionByName."""
    return ops.select(F.lit(kind).alias("operation_type"), at.alias("started_at"), duration.cast("double").alias("duration_ms"), items.cast("long").alias("items_processed"), throughput(items, duration).alias("processing_rate"))


def progress(total: Column, done: Column, seconds: Column) -> Column:
    """(percent, items per second, seconds left)."""
    rate = F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))
    return F.struct(F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0)).alias("percent"), rate.alias("rate"), F.when(rate > 0, (total - done) / rate).alias("seconds_left"))


def adaptive_timeout(base_ms: float, latency_factor: Column, failure_rate: Column) -> Column:
    """base x latency factor x (1 + failure rate), between half and three times the base."""
    return F.greatest(F.lit(base_ms / 2), F.least(F.lit(base_ms * 3), F.lit(base_ms) * latency_factor * (1 + failure_rate)))


def memory_level(mb: Column, warning: float, critical: float) -> Column:
    return F.when(mb >= critical, "critical").when(mb >= warning, "warning").otherwise("normal")


def establish_baseline(run: Callable[[], float], warm_up: int = 2, least: int = 10, most: int = 50, last: int = 5, most_cv: float = 15.0) -> dict[str, float]:
    """Measure a function (it returns milliseconds) until its last results are steady: mean, deviation, index percentiles, confidence."""
    for _ in range(warm_up):
        run()
    values: list[float] = []
    while len(values) < most:
        values.append(float(run()))
        recent = values[-last:]
        if len(values) >= least and statistics.fmean(recent) > 0 and statistics.pstdev(recent) / statistics.fmean(recent) * 100 <= most_cv:
            break
    s, n, mean = sorted(values), len(values), statistics.fmean(values)
    cv = statistics.pstdev(values) / mean * 100 if mean else 0.0
    return {"samples": n, "mean": mean, "deviation": statistics.pstdev(values), **{f"p{p}": s[n * p // 100] for p in (50, 95, 99)}, "confidence": min(1, n / most) * 0.3 + (1 - min(1, cv / most_cv)) * 0.4 + 0.3}
