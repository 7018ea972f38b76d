"""Streams of file changes: debounce, replacement by file, request bursts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.operators.lookup import is_note
from notelake.operators.maintenance import apply_batch, latest_changes
from notelake.session import drop_scratch, scratch, written
from notelake.sources.store import BucketedStore, VersionedStore

#: What the binary file source gives.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def note_stream(spark: SparkSession, root: str, pattern: str = "*.md", most_files: int = 50, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified, size, text) of files as they appear, at most ``most_files`` per trigger; excluded path prefixes (relative to the root) are left out."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(root)
    out = rows.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    for prefix in excluded:
        out = out.where(~F.col("path").startswith(prefix))
    return out


def change_stream(spark: SparkSession, root: str, schema: str, most_files: int = 50) -> DataFrame:
    """Change records from Parquet files that are added to a folder; only paths that are notes."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(root)
    return rows.where(is_note(F.col("file_path")))


def debounced(changes: DataFrame, path: str, at: str, seconds: int = 1, delay: str = "10 seconds") -> DataFrame:
    """The last change of each burst per path: changes each within so many seconds of the one before are one burst (session windows over event time).

    Late changes are taken until the watermark passes their burst.
    """
    order = F.struct(at, *[c for c in changes.columns if c not in (path, at)])
    return changes.withWatermark(at, delay).groupBy(F.session_window(at, f"{seconds} seconds"), path).agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("changes")).select(path, "last.*", "changes")


def first_requests(requests: DataFrame, by: list[str], at: str, within: str = "1 second") -> DataFrame:
    """Requests without repeats within the watermark's delay."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark(by)


def windowed_metrics(ops: DataFrame, at: str = "started_at", delay: str = "10 minutes") -> DataFrame:
    """Hourly count and mean duration per operation type over a stream; late rows are taken until the watermark."""
    return ops.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), "operation_type").agg(F.count(F.lit(1)).alias("operations"), F.avg("duration_ms").alias("mean_duration_ms")).select(F.col("w.start").alias("hour"), "operation_type", "operations", "mean_duration_ms")


def apply_stream(changes: DataFrame, store: VersionedStore | BucketedStore, fresh: Callable[[DataFrame], DataFrame], checkpoint: str, at: list[str], path: str = "file_path", kind: str = "change_type") -> StreamingQuery:
    """Keeps a store up to date: per micro-batch the last change of each path is applied and a new snapshot published.

    Of a store in buckets (by ``path``) only the buckets that the batch touches are read and written; another store is written whole.
    ``fresh`` makes the rows of created and modified paths from that batch. A batch that is run again after a failure gives the same snapshot content.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        last = latest_changes(batch, path, at, kind)
        if isinstance(store, BucketedStore):
            place = scratch(batch.sparkSession, "batch")
            last = written(last, "batch", place)
            touched = sorted(r["b"] for r in last.select(store.bucket().alias("b")).distinct().collect())  # at most the number of buckets
            store.publish(apply_batch(store.read(touched), last, fresh(last), path, kind), touched)
            drop_scratch(place)
        else:
            store.publish(apply_batch(store.read(), last, fresh(last), path, kind))

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
