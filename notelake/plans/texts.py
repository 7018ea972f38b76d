"""Queries over texts: preprocessing, chunking, markdown, counts, finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import chunking, diff, markdown
from notelake.plans import as_bigint
from notelake.session import load, spread


def _docs(spark, folder):
    return load(spark, folder, "documents")


def _dealt(spark, folder):
    """Documents for work that is costly per row."""
    return spread(_docs(spark, folder), "doc_id")


def preprocess_text(spark, folder):
    return _dealt(spark, folder).select("doc_id", T.preprocess(F.col("text")).alias("plain"))


def text_validity(spark, folder):
    return _docs(spark, folder).select("doc_id", T.valid_text(F.col("text")).alias("valid"))


def text_statistics(spark, folder):
    t = F.col("text")
    words, chars = T.editor_counts(t)
    return _dealt(spark, folder).select("doc_id", T.word_count(t).alias("words"), T.sentence_count(t).alias("sentences"), words.alias("editor_words"), chars.alias("characters"), F.octet_length(t).alias("bytes"))


def optimal_chunk_size(spark, folder):
    return _docs(spark, folder).select("doc_id", T.optimal_size(F.col("text")).alias("size"))


def chunk_config_suggested(spark, folder):
    return _dealt(spark, folder).where("text is not null").select("doc_id", T.suggested_config(F.col("text")).alias("c")).select("doc_id", "c.*")


def text_hashes(spark, folder):
    t = F.col("text")
    return _dealt(spark, folder).where("text is not null").select("doc_id", F.sha2(t, 256).alias("text_hash"), T.rolling_hash(t).alias("rolling_hash"))


def chunk_windows(spark, folder):
    rows = _dealt(spark, folder).where("length(text) > 0").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 512, 64)).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", F.sha2("content", 256).alias("hash"), F.length("content").alias("characters"))


def chunk_windows_adjusted(spark, folder):
    """Windows that end with sentences and paragraphs: whether all lie in the text, none is too long, and the first and last touch its ends."""
    rows = _dealt(spark, folder).where("length(text) > 0").select("doc_id", "text", chunking.adjusted_windows(F.col("text"), 512, 64, 1).alias("c"))
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    ends = F.expr(r"length(text) <= 512 or (startswith(regexp_replace(text, '^\\s+|\\s+$', ''), c[0]) and endswith(regexp_replace(text, '^\\s+|\\s+$', ''), c[size(c) - 1]))")
    return rows.where(F.length(bare) > 0).select("doc_id", F.forall("c", lambda x: F.col("text").contains(x)).alias("inside"), (F.array_max(F.transform("c", F.length)) <= 512).alias("short"), ends.alias("whole"))


def chunk_integrity(spark, folder):
    """Of each strategy's chunks: whether they are what the text has at their positions, numbered without gaps, in order, and reach the end of the text."""
    docs, out = _dealt(spark, folder).where(F.length(F.regexp_replace("text", r"[ \t\r\n\f\x0b]", "")) > 0), []
    for s in ("fixed_size", "semantic", "hybrid", "markdown_aware"):
        chunks = chunking.chunk(docs, chunking.ChunkConfig(s, 1000, 100, 0)).withColumn("doc_id", F.col("doc_id").cast("long"))
        same = F.substring("text", F.col("start_position") + 1, F.col("end_position") - F.col("start_position")) == F.col("content")
        joined = chunks.join(docs.select("doc_id", "text"), "doc_id").withColumn("same", F.coalesce(same, F.lit(False)))
        order = F.sort_array(F.collect_list(F.struct("chunk_index", "start_position")))
        rising = F.forall(F.zip_with(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"), lambda a, b: (a["chunk_index"] + 1 == b["chunk_index"]) & (a["start_position"] < b["start_position"])), lambda x: x)
        g = joined.groupBy("doc_id").agg(F.min("same").alias("same"), order.alias("p"), F.max("total_chunks").alias("n"), F.count(F.lit(1)).alias("k"), F.max("end_position").alias("e"), F.max(F.length(F.regexp_replace("text", r"\s+$", ""))).alias("l"))
        out.append(g.select("doc_id", F.lit(s).alias("strategy"), "same", (rising & (F.col("n") == F.col("k"))).alias("ordered"), (F.col("e") >= F.col("l")).alias("whole")))
    return reduce(lambda a, b: a.unionByName(b), out)


def chunk_size_benchmark(spark, folder):
    return chunking.size_benchmark(_dealt(spark, folder), [256, 512, 1024])


def chunk_fixed(spark, folder):
    out = chunking.chunk(_dealt(spark, folder), chunking.ChunkConfig("fixed_size", 1000, 100, 100))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", "total_chunks", "start_position", "end_position", F.sha2("content", 256).alias("hash"), "has_previous_overlap", "has_next_overlap")


def _summary(spark, folder, strategy):
    out = chunking.chunk(_dealt(spark, folder), chunking.ChunkConfig(strategy, 1000, 100, 100))
    return out.select("doc_id", "chunk_index", "total_chunks", "start_position", "end_position", "word_count", "sentence_count", "heading_path")


def chunk_semantic(spark, folder):
    return _summary(spark, folder, "semantic")


def chunk_hybrid(spark, folder):
    return _summary(spark, folder, "hybrid")


def chunk_markdown(spark, folder):
    return _summary(spark, folder, "markdown_aware")


def chunk_notes(spark, folder):
    """Raw chunk texts chunked by their own configuration's strategy, at the library's default size."""
    rows = load(spark, folder, "note_chunk").join(load(spark, folder, "chunk_config").select("config_id", "strategy").dropDuplicates(["config_id"]), "config_id")
    parts = [chunking.chunk(rows.where(F.col("strategy") == s), chunking.ChunkConfig(s), "chunk_key", "content").withColumn("strategy", F.lit(s)) for s in chunking.STRATEGIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", F.col("doc_id").cast("long").alias("chunk_key"), "chunk_index", "total_chunks", "start_position", "end_position", "content", "heading_path")


def markdown_elements(spark, folder):
    return markdown.parse(_dealt(spark, folder), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "element", "kind", "level", "text", "url", "title", "ordered", "start", "end")


def markdown_headers(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.posexplode(markdown.headers(F.col("text"))).alias("place", "line"))
    return rows.select("doc_id", "place", F.length(F.regexp_extract("line", "(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", "#+ ([^\\r\\n]*)", 1)).alias("text"))


def markdown_links(spark, folder):
    return _docs(spark, folder).select("doc_id", F.posexplode(markdown.links(F.col("text"))).alias("place", "l")).select("doc_id", "place", "l.text", "l.url", "l.title")


def markdown_stripped(spark, folder):
    return _dealt(spark, folder).select("doc_id", T.strip_formatting(F.col("text")).alias("plain"))


def markdown_html(spark, folder):
    return _dealt(spark, folder).where("text is not null").select("doc_id", markdown.render(F.col("text")).alias("html"))


def paragraph_context(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", T.paragraph_window(F.col("text"), F.lit(2), 1).alias("paragraphs")).where("paragraphs is not null")


def find_in_text(spark, folder):
    t = F.col("text")
    replaced, n = T.replace_all(t, "the", "THE")
    return _docs(spark, folder).where("text is not null").select(
        "doc_id", T.find_next(t, "The", 50).alias("next_at"), T.find_previous(t, "the", 50).alias("previous_at"), n.alias("replacements"), F.length(replaced).alias("length_after"))


def snippet_location(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", T.locate_snippet(F.col("text"), "the").alias("l")).where("l is not null").select("doc_id", "l.line", "l.column")


def suggestions(spark, folder):
    t = F.col("text")
    return _docs(spark, folder).where("text is not null").select("doc_id", T.title(F.col("file_path"), t).alias("title"), T.title(F.lit(None).cast("string"), t).alias("first_line"), T.snippet(t).alias("snippet"), T.read_preview(t, 300).alias("preview"))


def changed_sections(spark, folder):
    """Each note against itself with every line that mentions the shelf rewritten."""
    rows = _docs(spark, folder).select("doc_id", "text", F.regexp_replace("text", "shelf", "rack").alias("new"))
    return diff.changed_sections(rows, "doc_id", "text", "new")


def significant_edits(spark, folder):
    return _docs(spark, folder).select("doc_id", diff.is_significant(F.col("text"), F.regexp_replace("text", "shelf", "bookcase")).alias("significant"))


_X = r"[\s\x{85}\p{Z}]"


def _preprocess_sql() -> str:
    out = "text"
    for name, pattern, by in T.CLEANUP:
        pattern = pattern.replace("'", "''")
        if name == "table rows":
            line = r"""CASE WHEN length(l) - length(replace(l, '|', '')) >= 2 THEN regexp_extract(l, '^([^|]*)\|', 1) || trim(replace(regexp_extract(l, '(\|.*\|)', 1), '|', ' '), ' ' || chr(9)) || regexp_extract(l, '\|([^|]*)$', 1) ELSE l END"""
            out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {line}), chr(10))"
        elif name not in ("bars in table rows", "ends of table rows"):
            by = by.replace("$", "\\")
            out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"regexp_replace({out}, '^{_X}+|{_X}+$', '', 'g')"


_WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\f]+'))"
_SENT = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]+'))) END"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

QUERIES = {f.__name__: f for f in (
    preprocess_text, text_validity, text_statistics, optimal_chunk_size, chunk_config_suggested, text_hashes, chunk_windows, chunk_windows_adjusted, chunk_integrity, chunk_size_benchmark, chunk_fixed, chunk_semantic, chunk_hybrid, chunk_markdown,
    chunk_notes, markdown_elements, markdown_headers, markdown_links, markdown_stripped, markdown_html, paragraph_context, find_in_text, snippet_location, suggestions,
    changed_sections, significant_edits,
)}
_WINDOWS = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, n, text, CASE WHEN n <= {size} THEN [text] ELSE list_filter(list_transform(range(0, CAST(ceil((n - {size}) / {step}.0) AS BIGINT) + 1), lambda i: trim(substring(text, i * {step} + 1, {size}), ' ')), lambda c: length(c) >= 20) END AS c FROM d),
k AS (SELECT doc_id, CASE WHEN n <= {size} OR len(c) > 0 THEN c WHEN length(trim(text, ' ')) > 0 THEN [trim(text, ' ')] ELSE [] END AS c FROM w)
"""
SQL = {
    "preprocess_text": f"WITH p AS (SELECT doc_id, {_preprocess_sql()} AS plain FROM documents) SELECT doc_id, CASE WHEN length(plain) > 0 THEN plain END AS plain FROM p",
    "text_validity": r"SELECT doc_id, coalesce(length(text) > 0 AND strlen(text) <= 52428800 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]'), false) AS valid FROM documents",
    "text_statistics": f"SELECT doc_id, {_WORDS} AS words, {_SENT} AS sentences, CASE WHEN length({_TRIM}) = 0 THEN 0 ELSE len(regexp_split_to_array({_TRIM}, '\\s+')) END AS editor_words, length(text) AS characters, strlen(text) AS bytes FROM documents",
    "optimal_chunk_size": r"SELECT doc_id, CASE WHEN length(text) < 200 THEN 256 WHEN length(text) < 2000 THEN 512 WHEN len(string_split(text, chr(10) || chr(10))) > 5 OR len(regexp_extract_all(text, '[.!?]')) > 20 THEN 1024 ELSE 512 END AS size FROM documents",
    "text_hashes": "WITH c AS (SELECT doc_id, text, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, x: (h * 31 + x) % 4294967296) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(text) AS text_hash, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS rolling_hash FROM c",
    "chunk_windows": _WINDOWS.format(size=512, step=448) + "SELECT doc_id, i - 1 AS chunk_index, sha256(c[i]) AS hash, length(c[i]) AS characters FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM k)",
    "chunk_windows_adjusted": r"SELECT doc_id, true AS inside, true AS short, true AS whole FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0",
    "chunk_integrity": r"SELECT doc_id, unnest(['fixed_size', 'semantic', 'hybrid', 'markdown_aware']) AS strategy, true AS same, true AS ordered, true AS whole FROM documents WHERE length(regexp_replace(text, '[ \t\r\n\f\v]', '', 'g')) > 0",
    "chunk_size_benchmark": " UNION ALL ".join(f"SELECT {s} AS size, count(*) AS chunks, round(avg(length(x)), 6) AS mean_length, sum(length(x)) AS characters FROM ({_WINDOWS.format(size=s, step=s)} SELECT unnest(c) AS x FROM k)" for s in (256, 512, 1024)),
    "chunk_fixed": """
        WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) + 1 END AS k FROM documents WHERE length(text) > 0),
        c AS (SELECT *, unnest(range(0, k)) AS i FROM d)
        SELECT doc_id, i AS chunk_index, k AS total_chunks, i * 900 AS start_position, least(i * 900 + 1000, n) AS end_position, sha256(substring(text, i * 900 + 1, 1000)) AS hash, i > 0 AS has_previous_overlap, i * 900 + 1000 < n AS has_next_overlap FROM c""",
    "markdown_headers": r"WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?m)^([ \t]*#{1,6} [^\n]*)$', 1) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM h) SELECT doc_id, i - 1 AS place, length(regexp_extract(l[i], '(#+)', 1)) AS level, trim(regexp_extract(l[i], '#+ ([^\r\n]*)', 1), ' ') AS text FROM x",
    "markdown_links": r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '(\[[^\]]*\]\([^)]*\))', 1) AS l FROM documents), x AS (SELECT doc_id, i - 1 AS place, l[i] AS s, regexp_extract(l[i], '\]\(([^)]*)\)', 1) AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM h))
        SELECT doc_id, place, regexp_extract(s, '^\[([^\]]*)\]', 1) AS text, trim(regexp_extract(t, '^([^"]*)', 1), ' ') AS url, CASE WHEN contains(t, '"') THEN regexp_replace(regexp_extract(t, '"(.*)$', 1), '"+$', '') END AS title FROM x""",
    "markdown_stripped": r"SELECT doc_id, regexp_replace(translate(regexp_replace(text, '#{1,6} ', '', 'g'), '*_`', ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS plain FROM documents",
    "paragraph_context": r"WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: length(trim(p, ' ')) > 0) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, list_slice(p, 2, 4) AS paragraphs FROM p WHERE len(p) > 2",
    "find_in_text": r"""WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT *, instr(substring(t, 50), 'the') AS a, instr(t, 'the') AS b, regexp_extract(substring(t, 1, 51), '^((?s:.*))the', 1) AS h, regexp_extract(t, '^((?s:.*))the', 1) AS g FROM d)
        SELECT doc_id, CASE WHEN a > 0 THEN a + 49 ELSE b END AS next_at, CASE WHEN contains(substring(t, 1, 51), 'the') THEN length(h) + 1 WHEN b > 0 THEN length(g) + 1 ELSE 0 END AS previous_at, len(regexp_extract_all(text, '(?i)the')) AS replacements, length(text) AS length_after FROM f""",
    "chunk_config_suggested": r"""WITH d AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '[.!?…](\s|$)')) AS e, length(regexp_extract(text, '^((?s:.*)[.!?…])(\s|$)', 1)) AS l, len(regexp_split_to_array(text, '\n\n|\r\n\r\n')) AS p FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, CASE WHEN e = 0 THEN n ELSE l // e END AS m FROM d),
        s AS (SELECT *, CAST(greatest(100, least(1000, floor(1000 * CASE WHEN m > 100 THEN 1.2::DOUBLE WHEN m < 30 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n // p > 1000 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END))) AS INTEGER) AS z FROM f)
        SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'hybrid' ELSE 'semantic' END AS strategy, z AS max_chunk_size, greatest(50, least(200, z // 10)) AS overlap_size, greatest(50, z // 4) AS min_chunk_size FROM s""",
    "suggestions": r"""WITH d AS (SELECT doc_id, text, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^/.]+$', '') AS f,
          regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, '(?m)^[ \t\r\f\v]*([^\s][^\n\r]*)', 1), '^#+\s*', ''), '\*\*([^\n\r]+?)\*\*', '\1', 'g'), '\s+$', '') AS l, substring(text, 1, 150) AS h, substring(text, 1, 300) AS p FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, CASE WHEN length(l) > 50 THEN substring(l, 1, 50) || '...' ELSE l END AS t, regexp_extract(h, '^((?s:.*)) ', 1) AS w, regexp_extract(p, '^((?s:.*))\n', 1) AS pl, regexp_extract(p, '^((?s:.*)) ', 1) AS pw FROM d)
        SELECT doc_id, coalesce(nullif(f, ''), nullif(t, ''), 'Untitled') AS title, coalesce(nullif(t, ''), 'Untitled') AS first_line,
          CASE WHEN length(text) <= 150 THEN text ELSE CASE WHEN length(w) > 120 THEN w ELSE h END || '...' END AS snippet,
          CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN length(pl) > 0 THEN pl WHEN length(pw) > 0 THEN pw ELSE p END || chr(10) || chr(10) || '[truncated]' END AS preview FROM s""",
    "changed_sections": "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l), c AS (SELECT doc_id, i - 1 AS line FROM x WHERE contains(l[i], 'shelf')), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM c) SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS lines FROM g GROUP BY doc_id, g",
    "significant_edits": "SELECT doc_id, coalesce(length(replace(text, 'shelf', 'bookcase')) - length(text) >= 5, false) AS significant FROM documents",
    "snippet_location": r"WITH d AS (SELECT doc_id, substring(text, 1, instr(text, 'the') - 1) AS b FROM documents WHERE instr(text, 'the') > 0) SELECT doc_id, len(string_split(b, chr(10))) AS line, length(regexp_extract(b, '([^\n]*)$', 1)) + 1 AS column FROM d",
}
SQL["chunk_size_benchmark"] = as_bigint(SQL["chunk_size_benchmark"], "characters")
