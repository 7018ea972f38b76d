"""Queries that run a streaming job to its end over what lies in a folder, and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.paths import plain_path
from notelake.operators import maintenance
from notelake.plans import EVENTS, KIND, PLAIN
from notelake.session import load, scratch
from notelake.sources.store import BucketedStore
from notelake.streaming import changes


def _stream(spark, folder, name) -> DataFrame:
    """A table as a stream of its files; the pattern in the path lets it be one file as well as a folder."""
    return spark.readStream.schema(load(spark, folder, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{name}.parque[t]")


def _finished(spark, df: DataFrame, mode: str) -> DataFrame:
    """Runs the stream with the available data. Each micro-batch replaces (complete) or extends (append) the written result."""
    at = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out/*")


def stream_hourly_metrics(spark, folder):
    ops = _stream(spark, folder, "events").select(F.col("event_type").alias("operation_type"), F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("duration_ms"))
    out = _finished(spark, changes.windowed_metrics(ops, delay="1 hour"), "complete")
    return out.select("hour", "operation_type", "operations", F.round("mean_duration_ms", 6).alias("mean_duration_ms"))


def stream_debounced(spark, folder):
    """Bursts of a user's events, by five minutes of quiet, that the watermark has closed."""
    rows = _stream(spark, folder, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    return _finished(spark, changes.debounced(rows, "path", "at", 300, "1 minute"), "append").select("path", "at", "kind", "changes")


def stream_applied_changes(spark, folder):
    """A store of the notes' paths, kept up to date from the change records in their order of arrival; only buckets that changes touch are written anew."""
    store = BucketedStore(spark, scratch(spark, "store"), 16, "file_path")
    live = load(spark, folder, "documents").where("file_path is not null").groupBy(plain_path(F.col("file_path")).alias("file_path")).agg(F.min("doc_id").cast("string").alias("id"))
    store.publish(live.select("id", "file_path"))
    feed = maintenance.moves_apart(_stream(spark, folder, "change_record").where("file_path is not null").select("file_path", "moved_to", "change_type", "record_id"))
    fresh = lambda last: last.select(F.concat(F.lit("new "), "file_path").alias("id"), "file_path")
    changes.apply_stream(feed, store, fresh, f"{store.root}/_checkpoint", ["record_id", "step"]).awaitTermination()
    return store.read()


QUERIES = {f.__name__: f for f in (stream_hourly_metrics, stream_debounced, stream_applied_changes)}
SQL = {
    "stream_hourly_metrics": "SELECT date_trunc('hour', ts) AS hour, event_type AS operation_type, count(*) AS operations, round(avg(value), 6) AS mean_duration_ms FROM events GROUP BY 1, 2",
    "stream_debounced": """
        WITH n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM n)
        SELECT CAST(user_id AS VARCHAR) AS path, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS kind, count(*) AS changes FROM b GROUP BY user_id, b
        HAVING max(ts) + INTERVAL 5 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 MINUTE""",
    "stream_applied_changes": f"""
        WITH c AS (SELECT {KIND} AS k, {PLAIN.format('file_path')} AS file_path, {PLAIN.format('moved_to')} AS moved_to, 0 AS s, 0 AS q, record_id FROM change_record WHERE file_path IS NOT NULL), {EVENTS},
        m AS (SELECT file_path, arg_max(k, (record_id, step)) AS k FROM ev GROUP BY file_path), d AS (SELECT doc_id, {PLAIN.format('file_path')} AS file_path FROM documents WHERE file_path IS NOT NULL)
        SELECT CAST(min(doc_id) AS VARCHAR) AS id, file_path FROM d WHERE file_path NOT IN (SELECT file_path FROM m) GROUP BY file_path
        UNION ALL SELECT 'new ' || file_path, file_path FROM m WHERE k <> 'deleted'""",
}
