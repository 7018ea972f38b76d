"""Plans: what is pruned, pushed down, limited early, and what never appears."""

import pytest
from pyspark.sql import functions as F

from notelake.operators import dedup, lookup, metrics, orphans, search
from notelake.session import load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_per_group_is_limited_before_the_shuffle(spark, data):
    ops = load(spark, data, "events").select(F.col("event_type").alias("operation_type"), F.col("value").alias("duration_ms"), F.col("ts").alias("started_at"), "event_id")
    for df in (metrics.trend(ops, "operation_type", "duration_ms", ["started_at", "event_id"]), lookup.live(load(spark, data, "embedding_entry"))):
        assert "WindowGroupLimit" in plan(df)


def test_metadata_queries_do_not_read_vectors(spark, data):
    entries = load(spark, data, "embedding_entry")
    for df in (lookup.index_statistics(entries), lookup.by_hash(entries), lookup.between(entries, 1, 2).select("id"), orphans.vault_orphans(entries, *(load(spark, data, n) for n in ("orphan_detection_result", "search_request", "file_info")))):
        text = plan(df)
        assert "vector" not in text.split("ReadSchema")[-1] and "vector:array" not in text


def test_time_range_is_pushed_down(spark, data):
    text = plan(lookup.between(load(spark, data, "embedding_entry"), 10, 20).select("id"))
    assert "GreaterThanOrEqual(created_at,10)" in text and "LessThanOrEqual(created_at,20)" in text


def test_texts_are_not_shuffled_to_find_copies(spark, data):
    text = plan(dedup.exact_mapping(load(spark, data, "documents"), ["text"], "doc_id"))
    assert "hashpartitioning(text" not in text and "hashpartitioning(digest" in text


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p5_report", "knn_topk", "knn_batch_topk", "live_view", "orphans_by_file", "apply_change_batch", "hourly_trends", "index_percentiles", "folder_tree", "chunk_semantic"])
def test_no_cross_join(spark, data, name):
    import __spark_entry__ as E

    text = plan(E.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_percentiles_aggregate_before_the_shuffle(spark, data):
    text = plan(metrics.index_percentiles(load(spark, data, "events"), "event_type", "value"))
    assert "partial_count" in text


def test_batch_search_keeps_few_rows_per_query(spark, data):
    rows = load(spark, data, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    assert "WindowGroupLimit" in plan(search.block_search(rows, rows, 5))
