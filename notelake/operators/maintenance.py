"""Store maintenance: live state after changes, deletes, compaction, integrity, health, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.paths import plain_path
from notelake.functions.vectors import is_finite, is_zero
from notelake.operators import compression, dedup
from notelake.operators.changes import change_kind, whole_seconds
from notelake.operators.lookup import entries_from_text, live
from notelake.operators.metrics import index_health
from notelake.session import written
from notelake.sources.batches import read_batches, write_batches
from notelake.sources.store import VersionedStore


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def delete_files(rows: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Without the rows of the given files; rows without a path stay."""
    return rows.join(files.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti")


def delete_older(rows: DataFrame, before: int, at: str = "created_at") -> DataFrame:
    """Without rows created before a time; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= before))


def replace_files(rows: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of each file in ``fresh`` are replaced by the fresh ones, so nothing of a changed file's old text is left."""
    return delete_files(rows, fresh, path).unionByName(fresh)


def upsert(rows: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    return delete_ids(rows, fresh, key).unionByName(fresh)


def moves_apart(changes: DataFrame) -> DataFrame:
    """A move as the deletion of ``file_path`` (step 0) and the creation of ``moved_to`` (step 1), so a move onto itself leaves the file. Adds ``step``;
    ``change_type`` becomes the canonical one, rows of unknown type are void; paths come in plain form, ``detected_at`` (if there) in whole seconds."""
    rest = [c for c in changes.columns if c not in ("file_path", "moved_to", "change_type")]
    event = lambda path, kind, step: F.struct(path.alias("file_path"), kind.alias("change_type"), F.lit(step).alias("step"))
    plain = {c: plain_path(F.col(c)) for c in ("file_path", "moved_to")} | ({"detected_at": whole_seconds(F.col("detected_at"))} if "detected_at" in rest else {})
    known = changes.withColumns(plain | {"change_type": change_kind(F.col("change_type"))}).where("change_type is not null")
    moved = F.array(event(F.col("file_path"), F.lit("deleted"), 0), event(F.col("moved_to"), F.lit("created"), 1))
    events = F.when(F.col("change_type") == "moved", moved).otherwise(F.array(event(F.col("file_path"), F.col("change_type"), 0)))
    return known.select(*rest, F.explode(events).alias("e")).select("e.*", *rest).where("file_path is not null")


def latest_changes(changes: DataFrame, path: str, at: list[str], kind: str) -> DataFrame:
    """Last change per path (ties by kind). Partial maxima before the shuffle, so a path with most changes isn't hot."""
    order = F.struct(*at, kind)
    return changes.where(F.col(path).isNotNull()).groupBy(path).agg(F.max(order).alias("m")).select(path, F.col(f"m.{kind}").alias(kind), *[F.col(f"m.{c}").alias(c) for c in at])


def apply_batch(rows: DataFrame, changes: DataFrame, fresh: DataFrame, path: str = "file_path", kind: str = "change_type") -> DataFrame:
    """State after a batch: paths deleted or modified lose their rows, paths created or modified get the fresh rows. ``changes`` has one row per path."""
    gone = changes.where(F.col(kind).isin("deleted", "modified", "created"))
    new = fresh.join(changes.where(F.col(kind) != "deleted").select(path), path, "left_semi")
    return delete_files(rows, gone, path).unionByName(new.select(*rows.columns))


def integrity(stored: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are stored and indexed, only stored, only indexed."""
    a, b = stored.select(key).distinct().withColumn("s", F.lit(1)), indexed.select(key).distinct().withColumn("i", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("s").isNotNull() & F.col("i").isNotNull()).alias("indexed_rows"), F.count_if(F.col("i").isNull()).alias("orphaned_rows"), F.count_if(F.col("s").isNull()).alias("missing_rows"))


def outside_roots(rows: DataFrame, roots: list[str], path: str = "file_path") -> DataFrame:
    """Rows whose path begins with none of the roots (an empty list: none is outside)."""
    if not roots:
        return rows.limit(0)
    inside: Column = F.lit(False)
    for r in roots:
        inside = inside | F.col(path).startswith(r)
    return rows.where(F.col(path).isNotNull() & ~inside)


def cleanup_batch(orphans: DataFrame, key: str = "id", most: int = 100) -> DataFrame:
    """The orphans of one cleaning cycle: at most ``most``, in key order."""
    return orphans.orderBy(key).limit(most)


def corruption(rows: DataFrame) -> DataFrame:
    """Counts of zero vectors and of empty metadata over all rows, with the share and the verdict."""
    empty = F.coalesce(F.trim("file_path") == "", F.lit(True)) | F.coalesce(F.trim("chunk_id") == "", F.lit(True)) | F.coalesce(F.trim("model_name") == "", F.lit(True))
    bad = F.col("vector").isNull() | is_zero(F.col("vector"))
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_vectors"), F.count_if(empty).alias("empty_metadata"), F.count_if(bad | empty).alias("corrupt"))
    return out.withColumn("corrupt_share", F.when(F.col("rows") > 0, F.round(F.col("corrupt") / F.col("rows"), 6)).otherwise(F.lit(0.0)))


def should_compact(size_bytes: int, uncompressed_bytes: int, hours_since: float, cool_down: float = 24.0, least_gain: float = 0.3) -> bool:
    """After the cool-down, if compaction may gain more than the given share."""
    return hours_since >= cool_down and uncompressed_bytes > 0 and 1 - size_bytes / uncompressed_bytes > least_gain


def should_optimise(hours_since: float, uses: int, size_growth: float, latency_growth: float, cool_down: float = 6.0, each_hours: float = 24.0, each_uses: int = 1000, growth: float = 0.2) -> str | None:
    """What triggers optimisation after the cool-down: performance, size, usage or time; None if nothing does."""
    if hours_since < cool_down:
        return None
    return "performance" if latency_growth > growth else "size" if size_growth > growth else "usage" if uses >= each_uses else "time" if hours_since >= each_hours else None


def compact(store: VersionedStore, live: DataFrame, files: int, keep: int = 3, by: list[str] | None = None) -> int:
    """Publish the live rows as a fresh snapshot of so many files and drop the oldest snapshots."""
    version = store.publish(live.repartition(files, *(by or [])) if by else live.repartition(files))
    store.retain(keep)
    return version


def storage_metrics(rows: DataFrame) -> DataFrame:
    """Rows, files, bytes and rows per file of a Parquet-backed table."""
    each = rows.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"))
    return each.agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.avg("n").alias("entries_per_file"))


def health_report(rows: DataFrame) -> dict[str, object]:
    """Storage metrics and :func:`index_health` of a table."""
    m = storage_metrics(rows).first()
    return {"entries": m["entries"] or 0, "files": m["files"], "bytes": m["bytes"] or 0} | index_health(m["entries"] or 0, m["files"], m["bytes"] or 0)


def expired(files: DataFrame, now: int) -> DataFrame:
    """Retention over a listing (path, modified in epoch seconds): temporary files after an hour, stale locks after 5 minutes, logs after 7 days, backups beyond the newest 10."""
    kind = F.when(F.col("path").rlike(r"\.tmp$"), "temporary").when(F.col("path").rlike(r"\.lock$"), "lock").when(F.col("path").rlike(r"\.log$"), "log").when(F.col("path").rlike(r"(^|/)backup_|\.bak$"), "backup")
    age = F.lit(now) - F.col("modified")
    newest = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("modified"), "path"))
    kinds = files.withColumn("kind", kind).where("kind is not null")
    backups = kinds.where("kind = 'backup'").withColumn("_n", newest).where("_n > 10").drop("_n")
    others = kinds.where(((F.col("kind") == "temporary") & (age > 3600)) | ((F.col("kind") == "lock") & (age > 300)) | ((F.col("kind") == "log") & (age > 7 * 86400)))
    return others.unionByName(backups)


def to_compress(files: DataFrame, now: int, least_age: int = 86_400) -> DataFrame:
    """Of a listing (path, modified): batch files more than a day old that aren't compressed yet."""
    return files.where(F.col("path").rlike(r"\.json$") & (F.lit(now) - F.col("modified") > least_age)).select("path")


def compressed(spark: SparkSession, source: str, target: str, codec: str = "gzip") -> int:
    """Batch files of one folder written compressed into another, read back and counted; the number of entries, which must be the same on both sides."""
    rows = read_batches(spark, source)
    write_batches(rows, target, codec)
    n, again = rows.count(), read_batches(spark, target).count()
    if n != again:
        raise ValueError(f"{again} of {n} entries came back")
    return n


def maintenance_cycle(store: VersionedStore, orphan_ids: DataFrame, files: int = 1, key: str = "id") -> dict[str, int]:
    """Orphans of this cycle out, compacted, old snapshots dropped."""
    rows = store.read()
    batch = cleanup_batch(orphan_ids.select(key).distinct(), key)
    before = rows.count()
    version = compact(store, delete_ids(rows, batch, key), files)
    return {"version": version, "removed": before - store.read().count()}


def optimise(store: VersionedStore, threshold: float = 0.95, files: int = 1, bits: int | None = None) -> dict[str, int]:
    """Deduplicate, compress (with ``bits``: 8 or 16, vectors become codes, low, scale), publish the survivors compacted, drop old snapshots. Rows need id, vector, created_at, updated_at, text_length."""
    rows = store.read()
    clusters = dedup.greedy_clusters(rows, threshold)
    mapping = dedup.reference_mapping(clusters, dedup.representatives(clusters, rows))
    before = rows.count()
    kept = dedup.without(rows, mapping)
    version = compact(store, compression.quantized(kept, "vector", bits).drop("vector") if bits else kept, files)
    return {"version": version, "removed": before - store.read().count()}


def rebuild(store: VersionedStore, texts: DataFrame, vectors: Callable[[DataFrame], DataFrame], model: str, at: int, most_errors: float = 0.1, files: int = 1) -> dict[str, object]:
    """The index made anew from (file_path, chunk_id, content): entries are built, embedded by ``vectors`` (adds ``vector`` to rows with ``content``), checked and published as
    one snapshot. Rows whose vector can't be used are left out; if their share is above ``most_errors`` nothing is published and ValueError is raised."""
    built = entries_from_text(texts.where("content is not null"), model, at)
    by_text = vectors(texts.where("content is not null").select("content").distinct()).select(F.sha2("content", 256).alias("text_hash"), "vector")
    rows = written(live(built.join(by_text, "text_hash", "left")), "rebuilt")
    bad = F.col("vector").isNull() | is_zero(F.col("vector")) | ~is_finite(F.col("vector"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("failed")).first()
    if n["rows"] and n["failed"] / n["rows"] > most_errors:
        raise ValueError(f"{n['failed']} of {n['rows']} rows have no usable vector")
    version = compact(store, rows.where(~F.coalesce(bad, F.lit(True))), files)
    return {"version": version, "rows": n["rows"] - n["failed"], "failed": n["failed"]}


def compact_metadata(preview: Column) -> Column:
    """Empty previews are stored as null; :func:`full_metadata` gives them back."""
    return F.nullif(preview, F.lit(""))


def full_metadata(preview: Column) -> Column:
    return F.coalesce(preview, F.lit(""))
