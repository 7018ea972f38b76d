"""Named queries with, where SQL can say the same, their DuckDB text."""

#: Modules with QUERIES and SQL, in the order in which they are listed.
MODULES = ["vault", "vectors", "texts", "entries", "operations", "files", "streams"]


def as_bigint(sql: str, *columns: str) -> str:
    """Sums of integers as the 64-bit integers that Spark gives."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns) + f") FROM ({sql})"


#: SQL of a change record's canonical type, of its whole seconds, and of its events (from c: k, file_path, moved_to, s, q, record_id), a move being two.
KIND = "CASE lower(trim(change_type)) WHEN 'removed' THEN 'deleted' WHEN 'renamed' THEN 'moved' ELSE lower(trim(change_type)) END"
SECONDS = "CASE WHEN detected_at >= 100000000000 THEN detected_at // 1000 ELSE detected_at END"
EVENTS = """ev AS (SELECT file_path, CASE WHEN k = 'moved' THEN 'deleted' ELSE k END AS k, s, q, 0 AS step, record_id FROM c WHERE k IN ('created', 'modified', 'deleted', 'moved')
    UNION ALL SELECT moved_to, 'created', s, q, 1, record_id FROM c WHERE k = 'moved' AND moved_to IS NOT NULL)"""
#: SQL of the plain form of a path.
PLAIN = "nfc_normalize(array_to_string(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/'))"
