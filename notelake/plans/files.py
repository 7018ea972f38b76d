"""Queries over file listings: trees, sorting, fuzzy search, statistics, snapshots, retention; and storage round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import paths as P
from notelake.functions import text as T
from notelake.operators import maintenance, orphans
from notelake.plans import as_bigint
from notelake.session import load, scratch
from notelake.sources import batches, embedder, vault
from notelake.sources.store import VersionedStore


def _files(spark, folder):
    return load(spark, folder, "file_info")


def latest_listing(spark, folder):
    return orphans.latest_listing(_files(spark, folder)).select("path", "size", "is_dir", "is_deleted")


def listing_sorted(spark, folder):
    rows = vault.sorted_listing(_files(spark, folder).select("path", "name", "is_dir", "modified", "size").distinct())
    return rows.select("path", "name", "is_dir")


def listing_by_size(spark, folder):
    return vault.sorted_listing(_files(spark, folder).select("path", "name", "is_dir", "modified", "size").distinct(), "size").select("path", "size")


def listing_page(spark, folder):
    rows = _files(spark, folder).select("path", "name").distinct().orderBy("path", "name")
    return rows.offset(100).limit(25)


def folder_tree(spark, folder):
    return vault.tree(orphans.latest_listing(_files(spark, folder))).select("path", "parent", "depth", "is_dir")


def folder_list(spark, folder):
    return vault.folders(orphans.latest_listing(_files(spark, folder)))


def vault_statistics(spark, folder):
    return vault.statistics(orphans.latest_listing(_files(spark, folder)).where("not coalesce(is_deleted, false)"))


def path_parts(spark, folder):
    p = F.col("path")
    return _files(spark, folder).select("path").distinct().select("path", P.file_name(p).alias("file"), P.extension(p).alias("extension"), P.parent_path(p).alias("parent"), P.stem(p).alias("stem"), P.plain_path(p).alias("plain"))


def natural_order(spark, folder):
    return _files(spark, folder).select("name").distinct().select("name", T.natural_key(F.col("name")).alias("key"))


def fuzzy_search(spark, folder):
    rows = _files(spark, folder).select("path", "name").distinct()
    return rows.select("path", "name", T.match_score(F.col("name"), F.col("path"), "log").alias("score")).where("score > 0")


def fuzzy_top(spark, folder):
    return fuzzy_search(spark, folder).orderBy(F.desc("score"), "path", "name").limit(20)


def snapshot_diff(spark, folder):
    rows = orphans.latest_listing(_files(spark, folder).where("listed_at < '2024-07-01'")).where("not coalesce(is_deleted, false) and not coalesce(is_dir, false)")
    later = orphans.latest_listing(_files(spark, folder)).where("not coalesce(is_deleted, false) and not coalesce(is_dir, false)")
    return vault.snapshot_changes(rows, later)


def retention(spark, folder):
    rows = _files(spark, folder).select("path", "modified").distinct()
    return maintenance.expired(rows, 1_740_000_000).select("path", "kind")


def significant_changes(spark, folder):
    """Size changes of at least 5 bytes between a file's listings."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("listed_at", "size")
    rows = _files(spark, folder).where("size is not null").select("path", "listed_at", "size").distinct().withColumn("before", F.lag("size").over(w))
    return rows.where(F.abs(F.col("size") - F.col("before")) >= 5).select("path", "listed_at", "before", "size")


def store_roundtrip(spark, folder):
    """Two snapshots, a rollback and a read of what is published."""
    store = VersionedStore(spark, scratch(spark, "store"))
    rows = load(spark, folder, "customer")
    first = store.publish(rows.where("c_acctbal >= 0"))
    store.publish(rows)
    store.rollback(first)
    return store.read().select("c_custkey", "c_name", "c_acctbal")


def batch_files_roundtrip(spark, folder):
    """Entries written as compressed JSON batches and read again."""
    path = scratch(spark, "batches")
    batches.write_batches(load(spark, folder, "embedding_entry").where("id is not null"), path, rows_per_file=200)
    return batches.read_batches(spark, path).groupBy("model_name").agg(F.count(F.lit(1)).alias("entries"), F.sum("text_length").alias("text_bytes"), F.sum(F.when(F.size("vector") > 0, F.size("vector"))).alias("elements"))


def embedded_notes(spark, folder):
    """Chunk texts embedded by the test embedder, each distinct text once."""
    rows = load(spark, folder, "note_chunk").select("chunk_key", F.col("content").alias("text"))
    cache = spark.createDataFrame([], "key string, vector array<float>")
    out = embedder.embed_with_cache(rows, cache, embedder.hash_embedder(32))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count("vector").alias("embedded"), F.max(F.size("vector")).alias("dimension"))


_P = "nfc_normalize(array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/'))"
_LATEST = "f AS (SELECT p AS path, r[1] AS listed_at, r[2] AS modified, r[3] AS size, r[4] AS is_dir, r[5] AS is_deleted, r[6] AS name FROM (SELECT {p} AS p, max((listed_at, modified, size, is_dir, is_deleted, name)) AS r FROM file_info WHERE path IS NOT NULL {w} GROUP BY 1))"
_F = "WITH " + _LATEST.format(p=_P, w="")
_FUZZY = """
WITH f AS (SELECT DISTINCT path, name, lower(name) AS n FROM file_info),
s AS (SELECT *, list_reduce(list_prepend([0, 0, 0]::BIGINT[], list_transform(range(1, length(n) + 1), lambda i: [i, 0, 0]::BIGINT[])), lambda a, x:
  CASE WHEN a[2] < 3 AND substring(n, x[1], 1) = substring('log', a[2] + 1, 1)
  THEN [a[1] + 10 + CASE WHEN x[1] = a[3] + 1 THEN 5 ELSE 0 END + CASE WHEN x[1] = 1 OR substring(n, x[1] - 1, 1) IN (' ', '-', '_') THEN 15 ELSE 0 END, a[2] + 1, x[1]] ELSE a END) AS r FROM f),
z AS (SELECT path, name, CASE WHEN n = 'log' THEN 1000 WHEN starts_with(n, 'log') THEN 800 WHEN contains(n, 'log') THEN 600 WHEN contains(lower(path), 'log') THEN 400 WHEN r[2] = 3 THEN greatest(0, r[1] - (length(n) - 3)) ELSE 0 END AS score FROM s)
"""
QUERIES = {f.__name__: f for f in (
    latest_listing, listing_sorted, listing_by_size, listing_page, folder_tree, folder_list, vault_statistics, path_parts, natural_order, fuzzy_search, fuzzy_top, snapshot_diff, retention, significant_changes,
    store_roundtrip, batch_files_roundtrip, embedded_notes,
)}
SQL = {
    "latest_listing": _F + " SELECT path, size, is_dir, is_deleted FROM f",
    "listing_sorted": "SELECT path, name, is_dir FROM (SELECT DISTINCT path, name, is_dir, modified, size FROM file_info) ORDER BY is_dir DESC, lower(name), path",
    "listing_by_size": "SELECT path, size FROM (SELECT DISTINCT path, name, is_dir, modified, size FROM file_info) ORDER BY is_dir DESC, size DESC, path",
    "listing_page": "SELECT path, name FROM (SELECT DISTINCT path, name FROM file_info) ORDER BY path, name LIMIT 25 OFFSET 100",
    "folder_tree": _F + " SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, len(string_split(path, '/')) - 1 AS depth, is_dir FROM f",
    "folder_list": _F + ", p AS (SELECT string_split(path, '/') AS s FROM f) SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)",
    "vault_statistics": _F + " SELECT count(*) FILTER (NOT is_dir AND ends_with(lower(path), '.md')) AS notes, count(*) FILTER (is_dir) AS folders, sum(size) FILTER (NOT is_dir) AS bytes FROM f WHERE NOT coalesce(is_deleted, false)",
    "path_parts": f"SELECT path, regexp_extract(n, '([^/]*)$', 1) AS file, lower(regexp_extract(regexp_extract(n, '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS extension, regexp_extract(n, '^(.*)/[^/]*$', 1) AS parent, regexp_replace(regexp_extract(n, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, {_P} AS plain FROM (SELECT DISTINCT path, replace(path, '\\', '/') AS n FROM file_info)",
    "natural_order": r"SELECT DISTINCT name, regexp_replace(regexp_replace(lower(name), '([0-9]+)', '00000000000\1', 'g'), '0*([0-9]{12})([^0-9]|$)', '\1\2', 'g') AS key FROM file_info",
    "fuzzy_search": _FUZZY + "SELECT path, name, score FROM z WHERE score > 0",
    "fuzzy_top": _FUZZY + "SELECT path, name, score FROM z WHERE score > 0 ORDER BY score DESC, path, name LIMIT 20",
    "snapshot_diff": "WITH a AS (WITH " + _LATEST.format(p=_P, w="AND listed_at < TIMESTAMPTZ '2024-07-01 00:00:00+00'") + " SELECT * FROM f WHERE NOT coalesce(is_deleted, false) AND NOT coalesce(is_dir, false)), b AS (" + _F + " SELECT * FROM f WHERE NOT coalesce(is_deleted, false) AND NOT coalesce(is_dir, false)) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.modified IS DISTINCT FROM b.modified OR a.size IS DISTINCT FROM b.size",
    "significant_changes": "SELECT path, listed_at, before, size FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY listed_at, size) AS before FROM (SELECT DISTINCT path, listed_at, size FROM file_info WHERE size IS NOT NULL)) WHERE abs(size - before) >= 5",
    "store_roundtrip": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0",
    "batch_files_roundtrip": "SELECT model_name, count(*) AS entries, sum(text_length) AS text_bytes, sum(CASE WHEN len(vector) > 0 THEN len(vector) END) AS elements FROM embedding_entry WHERE id IS NOT NULL GROUP BY 1",
    "embedded_notes": "SELECT count(*) AS rows, count(*) FILTER (content IS NOT NULL AND regexp_matches(content, '[^\\s\\x{85}\\p{Z}\\x1c-\\x1f]') AND strlen(content) <= 8192) AS embedded, 32 AS dimension FROM note_chunk",
    "retention": "SELECT path, CASE WHEN ends_with(path, '.tmp') THEN 'temporary' WHEN ends_with(path, '.lock') THEN 'lock' ELSE 'log' END AS kind FROM (SELECT DISTINCT path, modified FROM file_info) WHERE (ends_with(path, '.tmp') AND 1740000000 - modified > 3600) OR (ends_with(path, '.lock') AND 1740000000 - modified > 300) OR (ends_with(path, '.log') AND 1740000000 - modified > 604800)",
}
SQL["vault_statistics"] = as_bigint(SQL["vault_statistics"], "bytes")
SQL["batch_files_roundtrip"] = as_bigint(SQL["batch_files_roundtrip"], "text_bytes", "elements")
