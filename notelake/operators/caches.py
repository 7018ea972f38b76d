"""Caches as tables: hit and miss split, time to live, context checks, relevance, eviction scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators import ordered


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def split_hits(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests found in the cache with its columns, requests not found)."""
    joined = requests.join(cache.withColumn("_hit", F.lit(True)), key, "left")
    return joined.where("_hit").drop("_hit"), joined.where("_hit is null").select(*requests.columns)


def fresh(cache: DataFrame, now: int, ttl: int, at: str = "cached_at") -> DataFrame:
    return cache.where(F.col(at) > now - ttl)


def stale_count(cache: DataFrame, now: int, ttl: int, at: str = "cached_at") -> DataFrame:
    """Entries, and how many are past their time."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col(at) <= now - ttl).alias("expired"))


def least_recent(cache: DataFrame, keep: int, at: str, key: str) -> DataFrame:
    """Entries to evict so that ``keep`` most recent ones stay; ties by key."""
    kept = cache.orderBy(F.desc(at), key).limit(keep).select(key)
    return cache.join(kept, key, "left_anti")


def is_relevant(same_file: Column, age: Column, length_apart: Column, cursor_apart: Column, ttl: int = 300) -> Column:
    """Same file, not older than the time to live (nor from the future), less than 500 characters and 1000 positions apart."""
    return F.coalesce(same_file & age.between(0, ttl) & (F.abs(length_apart) < 500) & (F.abs(cursor_apart) < 1000), F.lit(False))


def relevance(same_file: Column, age: Column, cached_length: Column, length: Column, uses: Column, ttl: int = 300) -> Column:
    """(1 - age / ttl) x ratio of the lengths (0.5 if one is 0) x (1 + log10(uses) / 10, at most 1.5); 0 for another file; within 0..1."""
    time = F.when(age > ttl, 0.0).otherwise(1 - F.greatest(age, F.lit(0)) / F.lit(float(ttl)))
    ratio = F.when((cached_length == 0) | (length == 0), 0.5).otherwise(F.least(cached_length, length) / F.greatest(cached_length, length))
    boost = F.least(F.lit(1.5), 1 + F.log10(F.greatest(uses, F.lit(1))) * 0.1)
    return F.when(same_file, F.greatest(F.lit(0.0), F.least(F.lit(1.0), time * ratio * boost))).otherwise(F.lit(0.0))


def eviction_score(age: Column, uses: Column) -> Column:
    """Blend of recency (0.6) and frequency (0.4); the lowest goes first."""
    return 0.6 / (1 + age) + 0.4 * uses / (1 + uses)


def eviction_order(cache: DataFrame, policy: str, key: str = "key", age: str = "age", uses: str = "uses", ttl: str = "ttl_left", due: str = "next_use") -> DataFrame:
    """Adds ``score``: the lowest goes first. Policies: lru (seconds since the last use), lfu (uses), ttl (seconds left to live), blend (:func:`eviction_score`),
    predicted (seconds to the next use that is expected; the furthest goes first, never used again before all). Nulls go first."""
    score = {
        "lru": lambda: -F.col(age).cast("double"), "lfu": lambda: F.col(uses).cast("double"), "ttl": lambda: F.col(ttl).cast("double"),
        "blend": lambda: eviction_score(F.col(age), F.col(uses)), "predicted": lambda: -F.col(due).cast("double"),
    }
    if policy not in score:
        raise ValueError(f"policy must be one of {', '.join(score)}")
    return cache.withColumn("score", F.coalesce(score[policy](), F.lit(float("-inf"))))


def evicted(cache: DataFrame, policy: str, keep: int, key: str = "key", **columns: str) -> DataFrame:
    """Keys that go so that ``keep`` entries stay; ties by key."""
    kept = eviction_order(cache, policy, key, **columns).orderBy(F.desc("score"), key).limit(keep).select(key)
    return cache.select(key).join(kept, key, "left_anti")


def next_use(accesses: DataFrame, item: str, at: str, now: Column) -> DataFrame:
    """(item, next_use): seconds from now to the next use that is expected, the mean time between uses after the last one; null for items used once."""
    g = accesses.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    gap = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    return g.select(item, F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("last") + gap - now)).alias("next_use"))


def priority(base: Column, typing: Column, idle_ms: Column, recency: Column, load: Column, kind: Column, critical: Column, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> Column:
    """base x weighted sum of activity, recency, resources and kind x critical boost."""
    activity = F.when(typing > 0.7, 1.5).when(idle_ms < 5000, 1.2).otherwise(1.0)
    resources = F.when(load > 0.8, 0.7).when(load < 0.5, 1.1).otherwise(1.0)
    speed = F.when(kind == "suggestion", 1.2).when(kind == "search", 1.1).when(kind == "analysis", 0.9).when(kind == "maintenance", 0.8).otherwise(1.0)
    a, r, s, k = weights
    return base * (activity * a + recency * r + resources * s + speed * k) * F.when(critical, 2.0).otherwise(1.0)


def deduplicated_requests(requests: DataFrame, by: list[str], at: str, within: int) -> DataFrame:
    """Each request with the first one of its burst: requests with the same keys, each within so many seconds of the one before."""
    order = [at, "request_id"]
    rows = ordered.preceding(ordered.in_slices(requests, by, at), order, F.col(at), 1)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.coalesce(micros(F.col(at)) - micros(F.get("_before", F.lit(0))["v"]) > within * 1_000_000, F.lit(True))
    return ordered.carried(rows.withColumn("_new", new), order, F.when(F.col("_new"), F.col("request_id")), "served_by").select(*requests.columns, "served_by")
