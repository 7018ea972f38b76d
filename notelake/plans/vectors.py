"""Queries over embedding vectors: kernels, search, deduplication, quantization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import vectors as V
from notelake.operators import compression, dedup, search
from notelake.operators.entries import MODEL_DIMENSIONS
from notelake.plans import as_bigint
from notelake.session import load

NOW = 1_735_689_600
_AT = 1_700_000_000


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as entries: label is the model, tens of ids share a file; times are derived from the id."""
    i = F.col("vec_id")
    return load(spark, folder, "embeddings").select(
        i.alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("model_name"), F.concat(F.lit("notes/"), (i % 37).cast("string"), F.lit(".md")).alias("file_path"),
        (F.lit(_AT) + i * 3600).alias("updated_at"), (F.lit(NOW) - i * 7200).alias("created_at"), (i % 500 + 20).alias("text_length"),
    )


def _query(spark: SparkSession, folder: str) -> list[float]:
    """The vector of entry 0."""
    return list(load(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"])


def _others(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).where("id <> 0")


def _sim(c: str = "similarity"):
    return F.round(c, 6).alias(c)


def knn_topk(spark, folder):
    hits = search.top_k(_others(spark, folder), _query(spark, folder), search.SearchConfig(min_threshold=-1.0))
    return search.with_rank(hits, F.desc("similarity"), "id").select("id", "model_name", "file_path", _sim(), "rank")


def knn_default(spark, folder):
    hits = search.top_k(_others(spark, folder), _query(spark, folder), search.SearchConfig(min_threshold=0.1, k=50, max_results=20))
    return hits.select("id", _sim())


def threshold_search(spark, folder):
    return search.scored(_others(spark, folder), _query(spark, folder)).where("similarity >= 0.2").select("id", _sim())


def threshold_capped(spark, folder):
    hits = search.scored(_others(spark, folder), _query(spark, folder)).where("similarity >= 0.05").orderBy(F.desc("similarity"), "id").limit(50)
    return hits.select("id", _sim())


def knn_exclude_context(spark, folder):
    config = search.SearchConfig(min_threshold=-1.0, k=30, max_results=30, exclude_files=("notes/1.md", "notes/2.md", "notes/3.md"))
    return search.top_k(_others(spark, folder), _query(spark, folder), config, path="file_path").select("id", "file_path", _sim())


def knn_exclude_first(spark, folder):
    config = search.SearchConfig(min_threshold=-1.0, k=30, max_results=30, exclude_files=("notes/1.md", "notes/2.md", "notes/3.md"), pre_filter=True)
    return search.top_k(_others(spark, folder), _query(spark, folder), config, path="file_path").select("id", "file_path", _sim())


def knn_recency(spark, folder):
    hits = search.top_k(_others(spark, folder), _query(spark, folder), search.SearchConfig(min_threshold=-1.0, k=20, max_results=20))
    return search.recency_weighted(hits, 0.1).select("id", _sim())


def knn_age_rerank(spark, folder):
    hits = search.top_k(_others(spark, folder), _query(spark, folder), search.SearchConfig(min_threshold=-1.0, k=20, max_results=20))
    return search.age_reranked(hits, NOW).select("id", _sim(), F.round("age_score", 6).alias("age_score"))


def knn_approximate(spark, folder):
    config = search.SearchConfig(min_threshold=-1.0)
    return search.approximate_top_k(_others(spark, folder), _query(spark, folder), config, F.col("id"), seed=17, small=100).select("id", _sim())


def _batch(spark, folder, k, threshold=-1.0):
    rows = _rows(spark, folder).select(F.col("id").cast("string").alias("id"), "vector")
    asked = _rows(spark, folder).where("id % 20 = 0").select(F.col("id").cast("string").alias("id"), "vector")
    return search.block_search(asked, rows, k, threshold)


def knn_batch_topk(spark, folder):
    return _batch(spark, folder, 5).select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), _sim(), "rank")


def threshold_batch(spark, folder):
    return _batch(spark, folder, None, 0.3).select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), _sim())


def knn_batch_summary(spark, folder):
    n = load(spark, folder, "embeddings").count()
    out = search.summary(_batch(spark, folder, 5), n)
    return out.select(F.col("query").cast("long").alias("query"), "results", _sim("top_score"), _sim("mean_score"), F.round("efficiency", 9).alias("efficiency"))


def knn_diversity(spark, folder):
    rows = _rows(spark, folder).select(F.col("id").cast("string").alias("id"), "vector")
    hits = _batch(spark, folder, 20).join(rows, "id").select("query", "id", "similarity", "vector")
    return search.diverse(hits, 0.3, 10).withColumn("similarity", F.round("similarity", 6))


def knn_batch_recency(spark, folder):
    hits = _batch(spark, folder, 10).select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), "similarity").join(_rows(spark, folder).select("id", "updated_at"), "id")
    return search.recency_weighted(hits, 0.2, per=["query"]).select("query", "id", _sim())


def vector_norms(spark, folder):
    return load(spark, folder, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), V.dimension(F.col("embedding")).alias("dimension"))


def vector_normalize(spark, folder):
    scaled = F.transform("embedding", lambda x: x * 4)
    return load(spark, folder, "embeddings").select("vec_id", F.transform(V.normalize(scaled), lambda x: F.round(x, 5) + 0.0).alias("unit"))


def vector_validate(spark, folder):
    v = F.col("vector")
    return load(spark, folder, "embedding_entry").groupBy("model_name").agg(
        F.count_if(v.isNull()).alias("null_vectors"), F.count_if(F.size(v) == 0).alias("empty"), F.count_if(v.isNotNull() & ~V.is_finite(v)).alias("not_finite"),
        F.count_if((F.size(v) > 0) & V.is_zero(v)).alias("zero"), F.count(F.lit(1)).alias("rows"),
    )


def vector_equal(spark, folder):
    rows = load(spark, folder, "embeddings")
    again = rows.select("vec_id", F.transform("embedding", lambda x: x + F.when(F.col("vec_id") % 3 == 0, 0.001).otherwise(0.0).cast("float")).alias("other"))
    return rows.join(again, "vec_id").select("vec_id", V.almost_equal(F.col("embedding"), F.col("other")).alias("same"))


def vector_hash_groups(spark, folder):
    rows = load(spark, folder, "embedding_entry").where("vector is not null")
    return rows.groupBy(V.vector_hash(F.col("vector")).alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("hashes"))


def pairwise_statistics(spark, folder):
    rows = _rows(spark, folder).select(F.col("id").cast("string").alias("id"), "vector")
    pairs = dedup.close_pairs(rows, 0.2)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.max("similarity"), 6).alias("max_similarity"))


def _few(spark, folder):
    return _rows(spark, folder).select(F.col("id").cast("string").alias("id"), "vector", "created_at", "updated_at", "text_length")


def dedup_pairs(spark, folder):
    return dedup.close_pairs(_few(spark, folder), 0.35).select(F.least(F.col("a").cast("long"), F.col("b").cast("long")).alias("a"), F.greatest(F.col("a").cast("long"), F.col("b").cast("long")).alias("b"), _sim())


def duplication_analysis(spark, folder):
    return dedup.duplication_analysis(_few(spark, folder), 0.35).withColumn("mean_similarity", F.round("mean_similarity", 5))


def dedup_clusters(spark, folder):
    return dedup.greedy_clusters(_few(spark, folder), 0.35).select("seed", "member", _sim())


def _mapping(spark, folder, strategy="most_recent"):
    rows = _few(spark, folder)
    clusters = dedup.greedy_clusters(rows, 0.35)
    return dedup.reference_mapping(clusters, dedup.representatives(clusters, rows, strategy))


def dedup_mapping(spark, folder):
    return _mapping(spark, folder)


def dedup_survivors(spark, folder):
    return dedup.without(_few(spark, folder), _mapping(spark, folder)).select("id")


def dedup_statistics(spark, folder):
    return dedup.statistics(_few(spark, folder), _mapping(spark, folder, "longest_content"))


def dedup_integrity(spark, folder):
    rows, mapping = _few(spark, folder), _mapping(spark, folder, "earliest")
    return dedup.broken_references(rows, dedup.without(rows, mapping), mapping)


def dedup_central(spark, folder):
    rows = _few(spark, folder)
    return dedup.central_representatives(dedup.greedy_clusters(rows, 0.35), dedup.close_pairs(rows, 0.35))


def quantize_8bit(spark, folder):
    return compression.quantized(load(spark, folder, "embeddings"), "embedding", 8).select("vec_id", "codes", F.round("low", 6).alias("low"), F.round("scale", 9).alias("scale"))


def quantize_16bit_error(spark, folder):
    return compression.roundtrip_error(load(spark, folder, "embeddings"), "embedding", 16).select("vec_id", F.round("max_error", 9).alias("max_error"), F.col("within"))


def quantize_8bit_error(spark, folder):
    return compression.roundtrip_error(load(spark, folder, "embeddings"), "embedding", 8).select("vec_id", F.round("max_error", 6).alias("max_error"), F.col("within"))


def compression_ratio(spark, folder):
    return compression.ratios(load(spark, folder, "embeddings"), "embedding")


def delta_encode(spark, folder):
    rows = load(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return compression.delta_encoded(rows, 0.35).select("id", "reference", F.round("scale", 9).alias("scale"), F.size("codes").alias("dimension"))


def delta_roundtrip(spark, folder):
    rows = load(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    back = compression.delta_decoded(compression.delta_encoded(rows, 0.35))
    worst = F.array_max(F.zip_with("vector", "decoded", lambda a, b: F.abs(a - b)))
    return back.join(rows, "id").select("id", (worst <= F.col("scale") * 0.51 + 1e-6).alias("within"))


def vector_pool_roundtrip(spark, folder):
    """Entries through the pool of shared, delta-coded and raw vectors and back: how far any is off, by model."""
    rows = load(spark, folder, "embedding_entry").select("model_name", "vector", F.col("vector").alias("was"))
    out = None
    for model, width in MODEL_DIMENSIONS.items():
        held, shared = compression.pool_encoded(rows.where((F.col("model_name") == model) & (F.size("vector") == width)), 0.9)
        off = F.array_max(F.zip_with("was", "vector", lambda a, b: F.abs(a - b)))
        good = F.forall("was", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        each = compression.pool_decoded(held, shared).where(good).groupBy("model_name").agg(F.count(F.lit(1)).alias("entries"), (F.max(off / F.greatest(F.lit(1.0), F.array_max(F.transform("was", F.abs)))) < 0.01).alias("near"))
        out = each if out is None else out.unionByName(each)
    return out


def search_metrics(spark, folder):
    """The metrics row of a search, but for what the clock says."""
    _, row = search.monitored_top_k(_others(spark, folder), _query(spark, folder), search.SearchConfig(min_threshold=-1.0))
    return row.select("operation_type", "searched", "results", _sim("top_score"), _sim("mean_score"))


def vector_pool(spark, folder):
    rows = load(spark, folder, "embedding_entry").where("vector is not null").select("id", "vector")
    return compression.pool_statistics(rows)


_C = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
_BASE = f"""
WITH e AS (
  SELECT vec_id AS id, embedding AS v, CAST(label AS VARCHAR) AS model_name, 'notes/' || (vec_id % 37) || '.md' AS file_path,
         {_AT} + vec_id * 3600 AS updated_at, {NOW} - vec_id * 7200 AS created_at, vec_id % 500 + 20 AS text_length FROM embeddings),
q AS (SELECT v AS qv FROM e WHERE id = 0),
s AS (SELECT e.*, {_C.format('v', 'qv')} AS similarity FROM e, q WHERE id <> 0),
b AS (SELECT x.id AS query, y.id AS id, y.updated_at, {_C.format('x.v', 'y.v')} AS similarity FROM e x, e y WHERE x.id % 20 = 0),
br AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, CAST(id AS VARCHAR)) AS rank FROM b),
p AS (SELECT x.id AS a, y.id AS b, {_C.format('x.v', 'y.v')} AS similarity FROM e x, e y WHERE x.id < y.id)
"""
_TOP = "t AS (SELECT * FROM s ORDER BY similarity DESC, id LIMIT {0})"
_FILES = "('notes/1.md', 'notes/2.md', 'notes/3.md')"

QUERIES = {f.__name__: f for f in (
    knn_topk, knn_default, threshold_search, threshold_capped, knn_exclude_context, knn_exclude_first, knn_recency, knn_age_rerank, knn_approximate, knn_batch_topk, threshold_batch, knn_batch_summary,
    knn_diversity, knn_batch_recency, vector_norms, vector_normalize, vector_validate, vector_equal, vector_hash_groups, pairwise_statistics, dedup_pairs, duplication_analysis, dedup_clusters, dedup_mapping,
    dedup_survivors, dedup_statistics, dedup_integrity, dedup_central, quantize_8bit, quantize_16bit_error, quantize_8bit_error, compression_ratio, delta_encode, delta_roundtrip, vector_pool_roundtrip, search_metrics, vector_pool,
)}
_Q8 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT vec_id, v, list_min(v) AS low, CASE WHEN list_max(v) > list_min(v) THEN (list_max(v) - list_min(v)) / {0} ELSE 1.0 END AS scale FROM e),
c AS (SELECT *, list_transform(v, lambda x: CAST(least(round((x - low) / scale), {0}) AS INTEGER)) AS codes FROM p)
"""
# greedy clusters as a fold over the entries in id order; ids are texts
_GREEDY = _BASE + f""",
n AS (SELECT CAST(x.id AS VARCHAR) AS id, list(CAST(y.id AS VARCHAR) ORDER BY CAST(y.id AS VARCHAR)) FILTER (CAST(y.id AS VARCHAR) > CAST(x.id AS VARCHAR) AND {_C.format('x.v', 'y.v')} >= 0.35) AS near FROM e x, e y GROUP BY x.id),
o AS (SELECT list({{'id': id, 'near': coalesce(near, []), 'out': []::STRUCT(m VARCHAR, s VARCHAR)[]}} ORDER BY id) AS l FROM n),
g AS (SELECT unnest(list_reduce(list_prepend({{'id': '', 'near': []::VARCHAR[], 'out': []::STRUCT(m VARCHAR, s VARCHAR)[]}}, l), lambda a, x: CASE WHEN list_contains(list_transform(a.out, lambda k: k.m), x.id) THEN a
  ELSE {{'id': '', 'near': []::VARCHAR[], 'out': list_concat(a.out, list_transform(list_filter(x.near, lambda y: NOT list_contains(list_transform(a.out, lambda k: k.m), y)), lambda y: {{'m': y, 's': x.id}}))}} END).out) AS c FROM o),
c AS (SELECT c.s AS seed, c.m AS member FROM g),
cm AS (SELECT seed, member AS id FROM c UNION SELECT seed, seed FROM c)
"""
_MAP = """, cr AS (SELECT seed, arg_min(id, ({0}, id)) AS rep FROM (SELECT seed, cm.id, e.created_at, e.updated_at, e.text_length FROM cm JOIN e ON CAST(e.id AS VARCHAR) = cm.id) GROUP BY seed),
mp AS (SELECT cm.id AS member, rep AS representative FROM cm JOIN cr USING (seed) WHERE cm.id <> rep)
"""
SQL = {
    "dedup_clusters": _GREEDY + f"SELECT seed, member, round({_C.format('x.v', 'y.v')}, 6) AS similarity FROM c JOIN e x ON CAST(x.id AS VARCHAR) = seed JOIN e y ON CAST(y.id AS VARCHAR) = member",
    "dedup_mapping": _GREEDY + _MAP.format("-updated_at") + "SELECT * FROM mp",
    "dedup_survivors": _GREEDY + _MAP.format("-updated_at") + "SELECT CAST(id AS VARCHAR) AS id FROM e WHERE CAST(id AS VARCHAR) NOT IN (SELECT member FROM mp)",
    "dedup_statistics": _GREEDY + _MAP.format("-text_length") + ", t AS (SELECT (SELECT count(*) FROM e) AS a, (SELECT count(DISTINCT member) FROM mp) AS b) SELECT a AS rows, b AS replaced, a - b AS kept, (b * 100.0 / a)::DOUBLE AS reduction_percent FROM t",
    "dedup_central": _GREEDY + f", w AS (SELECT a.seed, a.id, round(avg({_C.format('x.v', 'y.v')}), 9) AS mean FROM cm a JOIN cm b ON a.seed = b.seed AND a.id <> b.id JOIN e x ON CAST(x.id AS VARCHAR) = a.id JOIN e y ON CAST(y.id AS VARCHAR) = b.id WHERE {_C.format('x.v', 'y.v')} >= 0.35 GROUP BY 1, 2) SELECT seed, arg_min(id, (-mean, id)) AS representative FROM w GROUP BY seed",
    "delta_encode": _GREEDY + f""", sim AS (SELECT CAST(x.id AS VARCHAR) AS id, CAST(y.id AS VARCHAR) AS ref, {_C.format('x.v', 'y.v')} AS s FROM e x JOIN e y ON x.id <> y.id WHERE CAST(x.id AS VARCHAR) IN (SELECT member FROM c) AND CAST(y.id AS VARCHAR) NOT IN (SELECT member FROM c) AND {_C.format('x.v', 'y.v')} >= 0.35),
        bf AS (SELECT id, arg_min(ref, (-s, ref)) AS reference FROM sim GROUP BY id),
        r AS (SELECT CAST(e.id AS VARCHAR) AS id, e.v::DOUBLE[] AS v, reference FROM e LEFT JOIN bf ON bf.id = CAST(e.id AS VARCHAR)),""" + """
        z AS (SELECT id, v, list_min(v) AS lo, CASE WHEN list_max(v) > list_min(v) THEN (list_max(v) - list_min(v)) / 255.0 ELSE 1.0 END AS sc FROM r WHERE reference IS NULL),
        y AS (SELECT id, list_transform(v, lambda x: lo + least(round((x - lo) / sc), 255.0) * sc) AS back FROM z),
        d AS (SELECT r.id, r.reference, CASE WHEN y.id IS NULL THEN r.v ELSE list_transform(range(1, len(r.v) + 1), lambda i: r.v[i] - y.back[i]) END AS w FROM r LEFT JOIN y ON r.reference = y.id)
        SELECT id, reference, round(CASE WHEN list_max(w) > list_min(w) THEN (list_max(w) - list_min(w)) / 255.0 ELSE 1.0 END, 9) AS scale, len(w) AS dimension FROM d""",
    "knn_diversity": _BASE + """, h AS (SELECT CAST(query AS VARCHAR) AS query, CAST(br.id AS VARCHAR) AS id, similarity, e.v::DOUBLE[] AS v FROM br JOIN e ON e.id = br.id WHERE rank <= 20),
        f AS (SELECT query, list([{'id': id, 's': similarity, 'v': v}] ORDER BY similarity DESC, id) AS l FROM h GROUP BY query),
        k AS (SELECT query, list_reduce(l, lambda a, x: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda y: list_cosine_similarity(y.v, x[1].v) >= 0.3)) = 0 THEN list_concat(a, x) ELSE a END) AS k FROM f)
        SELECT query, k[i].id AS id, round(k[i].s, 6) AS similarity, i AS rank FROM (SELECT query, k, unnest(range(1, len(k) + 1)) AS i FROM k)""",
    "knn_topk": _BASE + "SELECT id, model_name, file_path, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM s ORDER BY rank LIMIT 10",
    "knn_default": _BASE + "SELECT id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1 ORDER BY s.similarity DESC, id LIMIT 20",
    "threshold_search": _BASE + "SELECT id, round(similarity, 6) AS similarity FROM s WHERE s.similarity >= 0.2",
    "threshold_capped": _BASE + "SELECT id, round(similarity, 6) AS similarity FROM s WHERE s.similarity >= 0.05 ORDER BY s.similarity DESC, id LIMIT 50",
    "knn_exclude_context": _BASE + ", " + _TOP.format(30) + f" SELECT id, file_path, round(similarity, 6) AS similarity FROM t WHERE file_path NOT IN {_FILES}",
    "knn_exclude_first": _BASE + f"SELECT id, file_path, round(similarity, 6) AS similarity FROM s WHERE file_path NOT IN {_FILES} ORDER BY s.similarity DESC, id LIMIT 30",
    "knn_recency": _BASE + ", " + _TOP.format(20) + " SELECT id, round(least(1.0, similarity + 0.1 * (1 - (max(updated_at) OVER () - updated_at) / (max(updated_at) OVER () - min(updated_at) OVER ()))), 6) AS similarity FROM t",
    "knn_age_rerank": _BASE + ", " + _TOP.format(20) + f" SELECT id, round(similarity, 6) AS similarity, round(similarity * (1 + 0.1 * least(greatest(0.0, ({NOW} - created_at) / 86400.0), 30.0)), 6) AS age_score FROM t",
    "knn_approximate": _BASE + ", d AS (SELECT * FROM s ORDER BY ((id + 17) * 7919) % 104729, id LIMIT (SELECT greatest(least(CAST(floor(10 * sqrt(count(*))) AS BIGINT), count(*)), 100) FROM s)) SELECT id, round(similarity, 6) AS similarity FROM d ORDER BY d.similarity DESC, id LIMIT 10",
    "knn_batch_topk": _BASE + "SELECT query, id, round(similarity, 6) AS similarity, rank FROM br WHERE rank <= 5",
    "threshold_batch": _BASE + "SELECT query, id, round(similarity, 6) AS similarity FROM b WHERE b.similarity >= 0.3",
    "knn_batch_summary": _BASE + "SELECT query, count(*) AS results, round(max(similarity), 6) AS top_score, round(avg(similarity), 6) AS mean_score, round(count(*) / (SELECT count(*) FROM e), 9) AS efficiency FROM br WHERE rank <= 5 GROUP BY query",
    "knn_batch_recency": _BASE + ", t AS (SELECT *, max(updated_at) OVER (PARTITION BY query) AS hi, min(updated_at) OVER (PARTITION BY query) AS lo FROM br WHERE rank <= 10) SELECT query, id, round(least(1.0, similarity + 0.2 * (1 - (hi - updated_at) / (hi - lo))), 6) AS similarity FROM t",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding) AS dimension FROM embeddings",
    "vector_normalize": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 4 AS FLOAT))::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, list_transform(v, lambda x: round(x / n, 5) + 0.0) AS unit FROM n",
    "vector_validate": "SELECT model_name, count(*) FILTER (vector IS NULL) AS null_vectors, count(*) FILTER (len(vector) = 0) AS empty, count(*) FILTER (len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NOT NULL AND x = 0)) = len(vector)) AS zero, count(*) AS rows FROM embedding_entry GROUP BY model_name",
    "vector_equal": "SELECT vec_id, vec_id % 3 <> 0 AS same FROM embeddings",
    "vector_hash_groups": "SELECT n, count(*) AS hashes FROM (SELECT vector, count(*) AS n FROM embedding_entry WHERE vector IS NOT NULL GROUP BY vector) GROUP BY n",
    "pairwise_statistics": _BASE + "SELECT count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(max(similarity), 6) AS max_similarity FROM p WHERE similarity >= 0.2",
    "dedup_pairs": _BASE + "SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE p.similarity >= 0.35",
    "duplication_analysis": _BASE + ", c AS (SELECT * FROM p WHERE similarity >= 0.35), m AS (SELECT a AS i FROM c UNION SELECT b FROM c), r AS (SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM c) AS pairs, (SELECT round(avg(similarity), 5) FROM c) AS mean_similarity, (SELECT count(*) FROM m) AS members) SELECT *, round(members / entries, 6) AS rate, CASE WHEN mean_similarity > 0.9 THEN 0.98 WHEN mean_similarity > 0.7 THEN 0.95 ELSE 0.9::DOUBLE END AS suggested_threshold FROM r",
    "dedup_integrity": "SELECT CAST(NULL AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS problem WHERE false",
    "quantize_8bit": _Q8.format("255.0") + "SELECT vec_id, codes, round(low, 6) AS low, round(scale, 9) AS scale FROM c",
    "quantize_16bit_error": _Q8.format("65535.0") + ", d AS (SELECT *, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (low + codes[i] * scale)))) AS m FROM c) SELECT vec_id, round(m, 9) AS max_error, m <= scale * 0.51 AS within FROM d",
    "quantize_8bit_error": _Q8.format("255.0") + ", d AS (SELECT *, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (low + codes[i] * scale)))) AS m FROM c) SELECT vec_id, round(m, 6) AS max_error, m <= scale * 0.51 AS within FROM d",
    "compression_ratio": "SELECT count(*) AS vectors, sum(4 * len(embedding)) AS original_bytes, sum(len(embedding) + 16) AS bytes_8bit, sum(2 * len(embedding) + 16) AS bytes_16bit, round(sum(len(embedding) + 16) / sum(4 * len(embedding)), 6) AS ratio_8bit, round(sum(2 * len(embedding) + 16) / sum(4 * len(embedding)), 6) AS ratio_16bit FROM embeddings",
    "delta_roundtrip": "SELECT CAST(vec_id AS VARCHAR) AS id, true AS within FROM embeddings",
    "vector_pool": "WITH g AS (SELECT vector, count(*) AS n FROM embedding_entry WHERE vector IS NOT NULL GROUP BY vector) SELECT sum(n) AS vectors, count(*) AS pooled, sum(n) - count(*) AS shared, sum(4 * len(vector) * (n - 1)) AS saved_bytes FROM g",
}
SQL["vector_pool_roundtrip"] = """SELECT model_name, count(*) AS entries, true AS near FROM embedding_entry WHERE len(vector) = CASE model_name WHEN 'quill-embed-s' THEN 128 WHEN 'quill-embed-xs' THEN 64 END
    AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = len(vector) GROUP BY model_name"""
SQL["search_metrics"] = _BASE + "SELECT 'knn' AS operation_type, (SELECT count(*) FROM s) AS searched, count(*) AS results, round(max(similarity), 6) AS top_score, round(avg(similarity), 6) AS mean_score FROM (SELECT similarity FROM s ORDER BY similarity DESC, id LIMIT 10)"
SQL["compression_ratio"] = as_bigint(SQL["compression_ratio"], "original_bytes", "bytes_8bit", "bytes_16bit")
SQL["vector_pool"] = as_bigint(SQL["vector_pool"], "vectors", "shared", "saved_bytes")
