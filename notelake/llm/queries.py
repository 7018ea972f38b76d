"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import abuse, diverse, mixing, neighbours, packing, split
from notelake.operators.entries import usable_entries
from notelake.session import load, spread, written


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    return written(usable_entries(load(spark, folder, "embedding_entry")), "usable")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    wanted = load(spark, folder, "search_request").select(F.col("entry_id").alias("id"))
    return neighbours.pairs(neighbours.nearest(_usable(spark, folder), wanted, 5))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The queries are every entry whose id, as a number, is divisible by 20."""
    usable = _usable(spark, folder)
    number = F.conv(F.substring("id", -8, 8), 16, 10).cast("long")
    return neighbours.nearest(usable, usable.where(number % 20 == 0).select("id"), 5).withColumn("similarity", F.round("similarity", 4))


def _threshold(spark: SparkSession, folder: str) -> float | None:
    """``diversity_threshold`` of the configuration named default; null if it is missing."""
    row = load(spark, folder, "search_config").where("config_name = 'default'").agg(F.max("diversity_threshold").alias("t")).first()
    return row["t"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return diverse.close_groups(_usable(spark, folder), _threshold(spark, folder))


def p4_subset(spark: SparkSession, folder: str) -> DataFrame:
    return diverse.varied_subset(_usable(spark, folder), 256, _threshold(spark, folder))


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with the chosen one that stands for it."""
    return diverse.covered(_usable(spark, folder), 256)


def p4_subset_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Entries chosen of each model, and whether they lie farther apart than the threshold before any is crowded."""
    rows = p4_subset(spark, folder).where("place > 0")
    first = rows.groupBy("model_name").agg(F.min(F.when(F.col("crowded"), F.col("place"))).alias("from"), F.max(F.when(~F.col("crowded"), F.col("place"))).alias("to"), (F.count(F.lit(1)) + 1).alias("chosen"))
    return first.select("model_name", "chosen", F.coalesce(F.col("from") > F.col("to"), F.lit(True)).alias("kinds_first"))


def p4_coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that the chosen ones stand for, by model, with the number of these."""
    usable = _usable(spark, folder)
    rows = diverse.covered(usable, 256).join(usable.select("id", "model_name"), "id")
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("representative").alias("representatives"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(p3_pieces(spark, folder))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split(spread(load(spark, folder, "note_chunk").select("chunk_key", "content", "config_id"), "chunk_key"), load(spark, folder, "chunk_config"))


def p3_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk put together again from its pieces without their overlaps; whether all pieces are within the maximum and overlap as configured."""
    return split.rejoined(p3_pieces(spark, folder), load(spark, folder, "note_chunk"), load(spark, folder, "chunk_config"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_containers(spark, folder).where(F.col("piece") == 1).select("doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"))


def p6_utilisation(spark: SparkSession, folder: str) -> DataFrame:
    return packing.utilisation(p6_containers(spark, folder))


def p6_accounted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the tokens of its items in all containers, and whether it was cut."""
    return p6_containers(spark, folder).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), (F.max("pieces") > 1).alias("cut"))


def p6_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Containers beyond the capacity, and whether at least nineteen twentieths of the space are used (if it is more than twenty containers)."""
    each = p6_containers(spark, folder).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    enough = (F.count(F.lit(1)) <= 20) | (F.sum("tokens") >= 0.95 * packing.CAPACITY * F.count(F.lit(1)))
    return each.agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull"), F.coalesce(enough, F.lit(True)).alias("full"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_shares(spark, folder).where("cannot_reach").select("mix_id", "source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    report = mixing.report(mixing.plan(load(spark, folder, "documents"), load(spark, folder, "mix_target")))
    return report.withColumns({c: F.round(c, n) for c, n in (("target_tokens", 4), ("target_share", 9), ("reached_share", 9))})


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents"), load(spark, folder, "mix_target"))


def p7_mixture_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each mix and source by the documents chosen, and whether none is used more often than allowed."""
    most = load(spark, folder, "mix_target").select("mix_id", mixing.plain_source(F.col("source")).alias("source"), "max_repeats").distinct()
    return p7_mixture(spark, folder).join(most, ["mix_id", "source"]).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.min(F.col("times") <= F.col("max_repeats")).alias("within"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    return abuse.score(docs, abuse.fit(*abuse.training_rows(docs, load(spark, folder, "doc_label"))))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, folder))


def p8_counted(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that were scored, by source, and whether the flagged ones are some of them."""
    return p8_rates(spark, folder).select("source", "notes", F.col("flagged").between(0, F.col("notes")).alias("some"))


QUERIES = {
    "p8_counted": p8_counted,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p4_found": p4_found, "p4_subset": p4_subset, "p4_subset_sizes": p4_subset_sizes, "p4_coverage": p4_coverage, "p4_coverage_counts": p4_coverage_counts,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined,
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_accounted": p6_accounted, "p6_limits": p6_limits, "p6_utilisation": p6_utilisation,
    "p7_found": p7_found, "p7_shares": p7_shares, "p7_mixture": p7_mixture, "p7_mixture_totals": p7_mixture_totals,
}
_USABLE = """
WITH c AS (SELECT id, vector, model_name, nfc_normalize(array_to_string(list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/')) AS path
  FROM embedding_entry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, vector DESC) = 1),
u AS (SELECT id, vector::DOUBLE[] AS v, model_name, path FROM c
  WHERE len(vector) = CASE model_name WHEN 'quill-embed-s' THEN 128 WHEN 'quill-embed-xs' THEN 64 END
  AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = len(vector) AND len(list_filter(vector, lambda x: x <> 0)) > 0),
"""
_REACHED = """
        WITH d AS (SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, sum(coalesce(strlen(text), 0)) AS tokens FROM documents GROUP BY 1),
        t AS (SELECT *, weight / sum(weight) OVER (PARTITION BY mix_id) * size_factor * (SELECT sum(strlen(text)) FROM documents) AS target FROM mix_target),
        r AS (SELECT mix_id, t.source, weight, max_repeats, target, coalesce(tokens, 0) AS tokens, max_repeats * coalesce(tokens, 0) < target AS c,
          CASE WHEN max_repeats * coalesce(tokens, 0) < target THEN max_repeats * coalesce(tokens, 0) ELSE floor(target) END AS reached FROM t LEFT JOIN d ON t.source = d.source)
"""
SQL = {
    "p1_found": _USABLE + """
        p AS (SELECT q.id AS a, u.id AS b, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, u.v) DESC, u.id) AS n
          FROM u q JOIN u ON q.model_name = u.model_name AND q.id <> u.id AND (q.path IS NULL OR u.path IS NULL OR q.path <> u.path) WHERE q.id IN (SELECT entry_id FROM search_request))
        SELECT DISTINCT least(a, b) AS entry_a, greatest(a, b) AS entry_b FROM p WHERE n <= 5""",
    "p1_neighbours": _USABLE + """
        p AS (SELECT q.id AS query, u.id AS id, list_cosine_similarity(q.v, u.v) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, u.v) DESC, u.id) AS rank
          FROM u q JOIN u ON q.model_name = u.model_name AND q.id <> u.id AND (q.path IS NULL OR u.path IS NULL OR q.path <> u.path) WHERE CAST('0x' || right(q.id, 8) AS BIGINT) % 20 = 0)
        SELECT query, id, round(s, 4) AS similarity, rank FROM p WHERE rank <= 5""",
    # where a source can reach its target and isn't a handful of texts, the fit reaches it to the token (holds from scale 0.01 on)
    "p7_shares": _REACHED + """
        SELECT mix_id, source, weight, max_repeats, round(target, 4) AS target_tokens, CAST(tokens AS BIGINT) AS source_tokens, CAST(reached AS BIGINT) AS reached_tokens, c AS cannot_reach,
          round(target / sum(target) OVER (PARTITION BY mix_id), 9) AS target_share, round(reached / sum(reached) OVER (PARTITION BY mix_id), 9) AS reached_share FROM r""",
    "p4_found": "WITH RECURSIVE" + _USABLE.strip()[4:] + """
        l AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.model_name = y.model_name AND x.id <> y.id
          WHERE list_cosine_similarity(x.v, y.v) >= (SELECT max(diversity_threshold) FROM search_config WHERE config_name = 'default')),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a AS member_id, min(b) AS first_id FROM r GROUP BY a)
        SELECT first_id, member_id FROM m WHERE first_id < member_id""",
    "p7_mixture_totals": _REACHED + "SELECT mix_id, source, CAST(reached AS BIGINT) AS tokens, true AS within FROM r WHERE reached > 0",
    "p4_subset_sizes": _USABLE.rstrip().rstrip(",") + " SELECT model_name, least(256, count(*)) AS chosen, true AS kinds_first FROM u GROUP BY 1",
    "p4_coverage_counts": _USABLE.rstrip().rstrip(",") + " SELECT model_name, count(*) AS entries, least(256, count(DISTINCT v)) AS representatives FROM u GROUP BY 1",
    "p3_rejoined": "SELECT chunk_key, content AS text, true AS within, true AS overlapping FROM note_chunk",
    "p6_accounted": "SELECT doc_id, coalesce(strlen(text), 0) AS tokens, coalesce(strlen(text) > 8192, false) AS cut FROM documents",
    "p8_counted": "SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, count(*) AS notes, true AS some FROM documents GROUP BY 1",
    "p6_limits": "SELECT 0::BIGINT AS overfull, true AS \"full\"",
    "p3_found": "SELECT chunk_key FROM note_chunk JOIN chunk_config USING (config_id) WHERE length(content) > max_chunk_size",
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    "p7_found": """
        WITH d AS (SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, sum(coalesce(strlen(text), 0)) AS tokens FROM documents GROUP BY 1),
        t AS (SELECT *, sum(weight) OVER (PARTITION BY mix_id) AS sum_weight, (SELECT sum(strlen(text)) FROM documents) AS all_tokens FROM mix_target)
        SELECT mix_id, t.source FROM t LEFT JOIN d ON t.source = d.source
        WHERE max_repeats * coalesce(tokens, 0) < weight / sum_weight * size_factor * all_tokens""",
}
