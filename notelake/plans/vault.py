"""Queries over the vault's own tables: the change feed and the references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelake.operators import changes, orphans
from notelake.plans import PLAIN
from notelake.session import load, scratch
from notelake.sources.store import VersionedStore


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """All bucket results become visible at once: they are published as one snapshot and read from there."""
    store = VersionedStore(spark, scratch(spark, "files"))
    store.publish(changes.apply_changes(changes.path_events(load(spark, folder, "change_record"))))
    return store.read()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes.current_files(_state(spark, folder))


def p2_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that the feed ended, with the time of their end."""
    return _state(spark, folder).where("not alive").select("file_path", "seen_at", "seen_seq")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.vault_orphans(*(load(spark, folder, n) for n in ("embedding_entry", "orphan_detection_result", "search_request", "file_info")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


_plain = PLAIN.format


_EVENTS = f"""
WITH base AS (
  SELECT CASE lower(trim(change_type)) WHEN 'removed' THEN 'deleted' WHEN 'renamed' THEN 'moved' ELSE lower(trim(change_type)) END AS kind,
         {_plain('file_path')} AS file_path, {_plain('moved_to')} AS moved_to,
         CASE WHEN detected_at >= 100000000000 THEN detected_at // 1000 ELSE detected_at END AS seen_at, coalesce(watch_seq, -1) AS seq, content_hash
  FROM change_record WHERE file_path IS NOT NULL AND detected_at IS NOT NULL),
ev AS (
  SELECT file_path, kind IN ('created', 'modified') AS alive, seen_at, seq, 0 AS step, CASE WHEN kind <> 'moved' THEN content_hash END AS h
  FROM base WHERE kind IN ('created', 'modified', 'deleted', 'moved')
  UNION ALL SELECT moved_to, true, seen_at, seq, 1, content_hash FROM base WHERE kind = 'moved' AND moved_to IS NOT NULL),
st AS (
  SELECT file_path, arg_max(alive, (seen_at, seq, step, alive)) AS alive, max((seen_at, seq)) AS m,
         arg_max(h, (seen_at, seq, step, h)) FILTER (h IS NOT NULL) AS content_hash
  FROM ev GROUP BY file_path)
"""

_ORPHANS = f"""
WITH files AS (
  SELECT p, max((listed_at, modified, size, is_dir, is_deleted)) AS r
  FROM (SELECT *, {_plain('path')} AS p FROM file_info WHERE path IS NOT NULL) GROUP BY p),
stored AS (SELECT p FROM files WHERE NOT coalesce(r[5], false) AND NOT coalesce(r[4], false)),
refs AS (
  SELECT 'embedding_entry' AS ref_table, 'file_path' AS ref_field, id AS ref_id, 1 AS u, {_plain('file_path')} AS missing_key, make_timestamp(created_at * 1000000) AS t FROM embedding_entry
  UNION ALL SELECT 'orphan_detection_result', 'orphaned_entry_ids', CAST(run_id AS VARCHAR), 2, x, make_timestamp(detected_at * 1000000) FROM (SELECT run_id, detected_at, unnest(orphaned_entry_ids) AS x FROM orphan_detection_result)
  UNION ALL SELECT 'orphan_detection_result', 'missing_file_paths', CAST(run_id AS VARCHAR), 3, {_plain('x')}, make_timestamp(detected_at * 1000000) FROM (SELECT run_id, detected_at, unnest(missing_file_paths) AS x FROM orphan_detection_result)
  UNION ALL SELECT 'search_request', 'entry_id', CAST(request_id AS VARCHAR), 2, entry_id, CAST(requested_at AT TIME ZONE 'UTC' AS TIMESTAMP) FROM search_request),
parents AS (
  SELECT 1 AS u, p AS k FROM stored UNION SELECT 2, id FROM embedding_entry UNION SELECT 3, {_plain('file_path')} FROM embedding_entry),
found AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, missing_key, strftime(t, '%Y-%m') AS period
  FROM refs WHERE missing_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents WHERE parents.u = refs.u AND parents.k = refs.missing_key))
"""

QUERIES = {"p2_found": p2_found, "p2_tombstones": p2_tombstones, "p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p2_found": _EVENTS + "SELECT file_path, content_hash FROM st WHERE alive",
    "p2_tombstones": _EVENTS + "SELECT file_path, m[1] AS seen_at, m[2] AS seen_seq FROM st WHERE NOT alive",
    "p5_found": _ORPHANS + "SELECT * FROM found",
    "p5_report": _ORPHANS + "SELECT ref_table, ref_field, period, count(*) AS orphan_references, count(DISTINCT missing_key) AS missing_keys, count(DISTINCT ref_id) AS referring_rows FROM found GROUP BY ALL",
}
