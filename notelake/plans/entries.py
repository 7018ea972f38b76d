"""Queries over embedding entries: live view, lookups, validation, derived rows, set operations, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.paths import plain_path
from notelake.operators import caches, dedup, lookup, maintenance, orphans
from notelake.plans import EVENTS, KIND, PLAIN, SECONDS, as_bigint
from notelake.session import load

_FROM, _TO, _AGE = 1_710_000_000, 1_720_000_000, 1_715_000_000


def _e(spark, folder):
    return load(spark, folder, "embedding_entry")


def _live(spark, folder):
    return lookup.live(_e(spark, folder))


def _first_id(spark, folder):
    return _e(spark, folder).agg(F.min("id")).first()[0]


def live_view(spark, folder):
    return _live(spark, folder).select("id", "updated_at", "model_name")


def live_count(spark, folder):
    return _live(spark, folder).agg(F.count(F.lit(1)).alias("entries"))


def live_ids(spark, folder):
    return _e(spark, folder).where("id is not null").select("id").distinct()


def lookup_by_id(spark, folder):
    return lookup.get(_live(spark, folder), _first_id(spark, folder)).select("id", "file_path", "chunk_id", "updated_at")


def lookup_many(spark, folder):
    wanted = load(spark, folder, "search_request").select(F.col("entry_id").alias("id"))
    return lookup.get_many(_live(spark, folder), wanted).select("id", "file_path", "model_name")


def entry_exists(spark, folder):
    i = _first_id(spark, folder)
    return spark.createDataFrame([(i, lookup.exists(_e(spark, folder), i)), ("none", lookup.exists(_e(spark, folder), "none"))], "id string, found boolean")


def lookup_by_file(spark, folder):
    return _live(spark, folder).where(F.col("file_path") == "Inbox/quick-capture.md").select("id", "chunk_id")


def lookup_by_model(spark, folder):
    return _live(spark, folder).where(F.col("model_name") == "quill-embed-xs").select("id", "text_length")


def lookup_by_hash(spark, folder):
    return lookup.by_hash(_e(spark, folder))


def lookup_by_chunk(spark, folder):
    return _live(spark, folder).where("file_path = 'Inbox/quick-capture.md' and chunk_id = 'chunk_001'").select("id", "text_hash")


def time_range(spark, folder):
    return lookup.between(_live(spark, folder), _FROM, _TO).select("id", "created_at")


def distinct_paths(spark, folder):
    return _e(spark, folder).where("file_path is not null").select(plain_path(F.col("file_path")).alias("file_path")).distinct()


def distinct_models(spark, folder):
    return _e(spark, folder).select("model_name").distinct()


def entry_metadata(spark, folder):
    return lookup.metadata(_live(spark, folder)).select("id", "model_name", "dimension", "text_length")


def validation_problems(spark, folder):
    marked = _e(spark, folder).select("id", "model_name", "file_path", "chunk_id", "text_hash", "text_length", "vector").withColumn("problem", F.explode(lookup.problems()))
    return marked.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def validation_split(spark, folder):
    good, bad = lookup.quarantine(_e(spark, folder))
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("part"), "n").unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("quarantined").alias("part"), "n"))


def entry_footprint(spark, folder):
    return _e(spark, folder).groupBy("model_name").agg(F.sum(lookup.footprint()).alias("bytes"), F.max(lookup.footprint()).alias("largest"))


def entry_checksum(spark, folder):
    rows = _live(spark, folder).select("id", "file_path", "chunk_id", "text_length")
    return rows.select("id", F.length(lookup.row_checksum()).alias("digits"))


def entries_built(spark, folder):
    rows = load(spark, folder, "note_chunk").select("chunk_key", "file_path", "chunk_id", "content")
    return lookup.entries_from_text(rows, "hash-embed", 1_700_000_000).select("id", "text_hash", "text_length", "content_preview")


def index_statistics(spark, folder):
    return lookup.index_statistics(_live(spark, folder))


def custom_metadata(spark, folder):
    rows = _live(spark, folder).where("custom_metadata is not null").select(F.explode("custom_metadata").alias("key", "value"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("value").alias("values"))


def exact_duplicates(spark, folder):
    return dedup.exact_groups(load(spark, folder, "documents"), ["text"], "doc_id").select("original", "duplicates", "last")


def remove_duplicates(spark, folder):
    docs = load(spark, folder, "documents")
    return dedup.without(docs.select("doc_id", "source"), dedup.exact_mapping(docs, ["text"], "doc_id"), "doc_id")


def duplicate_references(spark, folder):
    docs = load(spark, folder, "documents")
    return dedup.resolve(docs.select("doc_id"), dedup.exact_mapping(docs, ["text"], "doc_id"), "doc_id")


def duplicate_counts(spark, folder):
    return dedup.merged_counts(dedup.exact_mapping(load(spark, folder, "documents"), ["text"], "doc_id"))


def orphans_by_file(spark, folder):
    files = orphans.latest_listing(load(spark, folder, "file_info")).where("not coalesce(is_deleted, false) and not coalesce(is_dir, false)").select("path")
    rows = _live(spark, folder).where("file_path is not null").select("id", plain_path(F.col("file_path")).alias("path"))
    return rows.join(files, "path", "left_anti").select("id", "path")


def orphans_outside_roots(spark, folder):
    return maintenance.outside_roots(_live(spark, folder), ["Inbox/", "Projects/", "Journal/"]).select("id")


def cleanup_batch(spark, folder):
    return maintenance.cleanup_batch(orphans_by_file(spark, folder).select("id"))


def delete_by_ids(spark, folder):
    gone = load(spark, folder, "search_request").select(F.col("entry_id").alias("id"))
    return maintenance.delete_ids(_live(spark, folder), gone).select("id")


def delete_by_files(spark, folder):
    gone = load(spark, folder, "change_record").where("lower(trim(change_type)) in ('deleted', 'removed')").select("file_path")
    return maintenance.delete_files(_live(spark, folder), gone).select("id")


def delete_older(spark, folder):
    return maintenance.delete_older(_live(spark, folder), _AGE).select("id")


def upsert_entries(spark, folder):
    live = _live(spark, folder).select("id", "model_name", "updated_at")
    fresh = live.where("model_name = 'quill-embed-xs'").withColumn("updated_at", F.lit(2_000_000_000).cast("long"))
    return maintenance.upsert(live, fresh).groupBy("model_name").agg(F.count(F.lit(1)).alias("entries"), F.max("updated_at").alias("newest"))


def replace_by_file(spark, folder):
    live = _live(spark, folder).select("id", "file_path")
    fresh = load(spark, folder, "note_chunk").where("content is not null and file_path is not null").select(F.sha2(F.concat_ws(":", "file_path", "chunk_id", F.col("chunk_key").cast("string")), 256).alias("id"), "file_path")
    return maintenance.replace_files(live, fresh).select("id")


def apply_change_batch(spark, folder):
    """The changes of the feed applied to the entries by file; moves are a deletion and a creation. Void are rows without path or time."""
    changes = load(spark, folder, "change_record").where("file_path is not null and detected_at is not null").select("file_path", "moved_to", "change_type", "detected_at", "watch_seq", "record_id")
    last = maintenance.latest_changes(maintenance.moves_apart(changes), "file_path", ["detected_at", "watch_seq", "step", "record_id"], "change_type")
    fresh = load(spark, folder, "note_chunk").where("file_path is not null").select(F.col("chunk_key").cast("string").alias("id"), plain_path(F.col("file_path")).alias("file_path"))
    return maintenance.apply_batch(_live(spark, folder).select("id", plain_path(F.col("file_path")).alias("file_path")), last, fresh).select("id")


def integrity_report(spark, folder):
    return maintenance.integrity(_live(spark, folder).select("id"), load(spark, folder, "search_request").select(F.col("entry_id").alias("id")).where("id is not null"))


def corruption_report(spark, folder):
    return maintenance.corruption(_live(spark, folder))


def cache_hits_and_misses(spark, folder):
    docs = load(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = load(spark, folder, "doc_label").select("doc_id").distinct().join(docs, "doc_id").groupBy("key").agg(F.min("doc_id").alias("cached_by"))
    hits, misses = caches.split_hits(docs, cache, "key")
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


def set_union_distinct(spark, folder):
    a = load(spark, folder, "documents").select("file_path")
    return a.union(load(spark, folder, "note_chunk").select("file_path")).where("file_path is not null").distinct()


def set_difference(spark, folder):
    return load(spark, folder, "documents").select("file_path").where("file_path is not null").subtract(_e(spark, folder).select("file_path"))


def set_intersection(spark, folder):
    return load(spark, folder, "documents").select("file_path").where("file_path is not null").intersect(_e(spark, folder).select("file_path"))


_L = "l AS (SELECT * FROM embedding_entry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, vector DESC NULLS LAST, file_path DESC NULLS LAST, chunk_id DESC NULLS LAST, created_at DESC NULLS LAST, content_preview DESC NULLS LAST, text_length DESC NULLS LAST, model_name DESC NULLS LAST, text_hash DESC NULLS LAST) = 1)"
_W = f"WITH {_L} "
_P = PLAIN
_BLANK = "coalesce(length(trim({0})), 0) = 0"
_RULES = {
    **{c: _BLANK.format(c) for c in ("id", "file_path", "chunk_id", "model_name")}, "text_hash": "coalesce(length(text_hash), 0) <> 64", "text_length": "coalesce(text_length, 0) <= 0",
    "vector_empty": "coalesce(len(vector), 0) = 0", "vector_not_finite": "coalesce(len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0, false)",
}
_FOOT = "4 * coalesce(len(vector), 0) + " + " + ".join(f"coalesce(strlen({c}), 0)" for c in ("id", "file_path", "chunk_id", "content_preview", "model_name", "text_hash")) + " + coalesce(list_sum(list_transform(map_entries(custom_metadata), lambda e: coalesce(strlen(e.key), 0) + coalesce(strlen(e.value), 0))), 0) + 40"
_DUP = "WITH g AS (SELECT text, min(doc_id) AS f, count(DISTINCT doc_id) AS n, max(doc_id) AS z FROM documents WHERE text IS NOT NULL GROUP BY text) "
_FILES = f"f AS (SELECT {_P.format('path')} AS p, max((listed_at, modified, size, is_dir, is_deleted)) AS r FROM file_info WHERE path IS NOT NULL GROUP BY 1), ok AS (SELECT p FROM f WHERE NOT coalesce(r[4], false) AND NOT coalesce(r[5], false))"
_ORPH = f"WITH {_L}, {_FILES} SELECT id, {_P.format('file_path')} AS path FROM l WHERE file_path IS NOT NULL AND {_P.format('file_path')} NOT IN (SELECT p FROM ok)"

QUERIES = {f.__name__: f for f in (
    live_view, live_count, live_ids, lookup_by_id, lookup_many, entry_exists, lookup_by_file, lookup_by_model, lookup_by_hash, lookup_by_chunk, time_range, distinct_paths, distinct_models, entry_metadata,
    validation_problems, validation_split, entry_footprint, entry_checksum, entries_built, index_statistics, custom_metadata, exact_duplicates, remove_duplicates, duplicate_references, duplicate_counts,
    orphans_by_file, orphans_outside_roots, cleanup_batch, delete_by_ids, delete_by_files, delete_older, upsert_entries, replace_by_file, apply_change_batch, integrity_report, corruption_report,
    cache_hits_and_misses, set_union_distinct, set_difference, set_intersection,
)}
SQL = {
    "live_view": _W + "SELECT id, updated_at, model_name FROM l",
    "live_count": "SELECT count(DISTINCT id) AS entries FROM embedding_entry",
    "live_ids": "SELECT DISTINCT id FROM embedding_entry WHERE id IS NOT NULL",
    "lookup_by_id": _W + "SELECT id, file_path, chunk_id, updated_at FROM l WHERE id = (SELECT min(id) FROM embedding_entry)",
    "lookup_many": _W + "SELECT id, file_path, model_name FROM l WHERE id IN (SELECT entry_id FROM search_request)",
    "entry_exists": "SELECT min(id) AS id, true AS found FROM embedding_entry UNION ALL SELECT 'none', false",
    "lookup_by_file": _W + "SELECT id, chunk_id FROM l WHERE file_path = 'Inbox/quick-capture.md'",
    "lookup_by_model": _W + "SELECT id, text_length FROM l WHERE model_name = 'quill-embed-xs'",
    "lookup_by_hash": "SELECT text_hash, arg_max(id, (updated_at, id)) AS id FROM embedding_entry WHERE text_hash IS NOT NULL GROUP BY text_hash",
    "lookup_by_chunk": _W + "SELECT id, text_hash FROM l WHERE file_path = 'Inbox/quick-capture.md' AND chunk_id = 'chunk_001'",
    "time_range": _W + f"SELECT id, created_at FROM l WHERE created_at BETWEEN {_FROM} AND {_TO}",
    "distinct_paths": f"SELECT DISTINCT {_P.format('file_path')} AS file_path FROM embedding_entry WHERE file_path IS NOT NULL",
    "distinct_models": "SELECT DISTINCT model_name FROM embedding_entry",
    "entry_metadata": _W + "SELECT id, model_name, len(vector) AS dimension, text_length FROM l",
    "validation_problems": " UNION ALL ".join(f"SELECT '{n}' AS problem, count(*) AS rows FROM embedding_entry WHERE {c} HAVING count(*) > 0" for n, c in _RULES.items()),
    "validation_split": f"SELECT CASE WHEN {' OR '.join(f'({c})' for c in _RULES.values())} THEN 'quarantined' ELSE 'valid' END AS part, count(*) AS n FROM embedding_entry GROUP BY part",
    "entry_footprint": f"SELECT model_name, sum({_FOOT}) AS bytes, max({_FOOT}) AS largest FROM embedding_entry GROUP BY model_name",
    "entry_checksum": _W + "SELECT id, 64 AS digits FROM l",
    "entries_built": "SELECT sha256(concat_ws(':', file_path, chunk_id, sha256(content))) AS id, sha256(content) AS text_hash, strlen(content) AS text_length, CASE WHEN length(content) <= 100 THEN content ELSE substring(content, 1, 97) || '...' END AS content_preview FROM note_chunk WHERE content IS NOT NULL",
    "index_statistics": _W + "SELECT count(*) AS entries, count(DISTINCT file_path) AS paths, count(DISTINCT model_name) AS models, count(DISTINCT text_hash) AS hashes, count(DISTINCT created_at // 3600) AS hour_buckets FROM l",
    "exact_duplicates": _DUP + "SELECT f AS original, n - 1 AS duplicates, z AS last FROM g WHERE n > 1",
    "remove_duplicates": _DUP + "SELECT doc_id, source FROM documents WHERE text IS NULL OR doc_id IN (SELECT f FROM g)",
    "duplicate_references": _DUP + "SELECT doc_id, coalesce(f, doc_id) AS resolved FROM documents LEFT JOIN g USING (text)",
    "duplicate_counts": _DUP + "SELECT f AS representative, n - 1 AS merged FROM g WHERE n > 1",
    "orphans_by_file": _ORPH,
    "orphans_outside_roots": _W + "SELECT id FROM l WHERE file_path IS NOT NULL AND NOT (starts_with(file_path, 'Inbox/') OR starts_with(file_path, 'Projects/') OR starts_with(file_path, 'Journal/'))",
    "cleanup_batch": f"SELECT id FROM ({_ORPH}) ORDER BY id LIMIT 100",
    "delete_by_ids": "SELECT DISTINCT id FROM embedding_entry WHERE id NOT IN (SELECT entry_id FROM search_request WHERE entry_id IS NOT NULL)",
    "delete_by_files": _W + "SELECT id FROM l WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM change_record WHERE lower(trim(change_type)) IN ('deleted', 'removed') AND file_path IS NOT NULL)",
    "delete_older": _W + f"SELECT id FROM l WHERE created_at IS NULL OR created_at >= {_AGE}",
    "upsert_entries": _W + "SELECT model_name, count(*) AS entries, max(CASE WHEN model_name = 'quill-embed-xs' THEN 2000000000 ELSE updated_at END) AS newest FROM l GROUP BY model_name",
    "replace_by_file": _W + ", n AS (SELECT sha256(concat_ws(':', file_path, chunk_id, CAST(chunk_key AS VARCHAR))) AS id, file_path FROM note_chunk WHERE content IS NOT NULL AND file_path IS NOT NULL) SELECT id FROM l WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT id FROM n",
    "apply_change_batch": _W + f""", c AS (SELECT {KIND} AS k, {_P.format('file_path')} AS file_path, {_P.format('moved_to')} AS moved_to, {SECONDS} AS s, coalesce(watch_seq, -1) AS q, record_id
            FROM change_record WHERE detected_at IS NOT NULL AND file_path IS NOT NULL), {EVENTS},
        m AS (SELECT file_path, arg_max(k, (s, q, step, record_id)) AS k FROM ev GROUP BY file_path), p AS (SELECT id, {_P.format('file_path')} AS file_path FROM l),
        n AS (SELECT chunk_key, {_P.format('file_path')} AS file_path FROM note_chunk WHERE file_path IS NOT NULL)
        SELECT id FROM p WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM m) UNION ALL SELECT CAST(chunk_key AS VARCHAR) FROM n JOIN m USING (file_path) WHERE k <> 'deleted'""",
    "integrity_report": "WITH a AS (SELECT DISTINCT id FROM embedding_entry WHERE id IS NOT NULL), b AS (SELECT DISTINCT entry_id AS id FROM search_request WHERE entry_id IS NOT NULL) SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS indexed_rows, count(*) FILTER (b.id IS NULL) AS orphaned_rows, count(*) FILTER (a.id IS NULL) AS missing_rows FROM a FULL JOIN b ON a.id = b.id",
    "corruption_report": _W + ", x AS (SELECT vector IS NULL OR len(vector) = 0 OR len(list_filter(vector, lambda x: x IS NOT NULL AND x = 0)) = len(vector) AS v, " + " OR ".join(_BLANK.format(c) for c in ("file_path", "chunk_id", "model_name")) + " AS m FROM l) SELECT count(*) AS rows, count(*) FILTER (v) AS bad_vectors, count(*) FILTER (m) AS empty_metadata, count(*) FILTER (v OR m) AS corrupt, round(count(*) FILTER (v OR m) / count(*), 6) AS corrupt_share FROM x",
    "cache_hits_and_misses": "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL) SELECT doc_id, key IN (SELECT key FROM d WHERE doc_id IN (SELECT doc_id FROM doc_label)) AS hit FROM d",
    "set_union_distinct": "SELECT file_path FROM documents WHERE file_path IS NOT NULL UNION SELECT file_path FROM note_chunk WHERE file_path IS NOT NULL",
    "set_difference": "SELECT file_path FROM documents WHERE file_path IS NOT NULL EXCEPT SELECT file_path FROM embedding_entry",
    "set_intersection": "SELECT file_path FROM documents WHERE file_path IS NOT NULL INTERSECT SELECT file_path FROM embedding_entry",
    "custom_metadata": _W + ", x AS (SELECT unnest(map_entries(custom_metadata)) AS e FROM l WHERE custom_metadata IS NOT NULL) SELECT e.key AS key, count(*) AS entries, count(DISTINCT e.value) AS values FROM x GROUP BY e.key",
}
SQL["entry_footprint"] = as_bigint(SQL["entry_footprint"], "bytes", "largest")
