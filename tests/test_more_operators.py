"""Measures, summaries, advice, eviction, pools, boundary windows, retries, rebuilds: small cases, by hand or by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import caches, chunking, compression, dedup, maintenance, markdown, metrics, search
from notelake.sources import batches, embedder
from notelake.sources.store import VersionedStore


def test_means_of_what_is_there(spark):
    df = spark.createDataFrame([("a", 10.0, 1, "success"), ("a", None, 3, "failed"), ("b", None, None, None)], "operation_type string, duration_ms double, items_processed int, status string")
    got = {r.operation_type: r for r in metrics.average_metrics(df).collect()}
    assert got["a"].asDict() == {"operation_type": "a", "operations": 2, "mean_duration_ms": 10.0, "mean_items_processed": 2.0, "success_rate": 0.5}
    assert got["b"].mean_duration_ms is None and got["b"].success_rate is None
    assert metrics.average_metrics(df.limit(0)).count() == 0


def test_advice(spark):
    df = spark.createDataFrame([("maintenance", 6000.0, 5.0), ("rebuilding", 40_000.0, 5000.0), ("incremental_update", 150.0, 1.0), ("other", 20.0, 1.0)], "operation_type string, mean_duration_ms double, mean_items_processed double")
    got = sorted(r.advice for r in metrics.recommendations(df).collect())
    assert got == ["incremental_update misses its target", "maintenance misses its target", "speed up maintenance", "speed up rebuilding", "split maintenance", "split rebuilding"]
    used = spark.createDataFrame([(85.0, 400.0)], "mean_cpu_percent double, peak_memory_mb double")
    assert [r.advice for r in metrics.resource_advice(used).collect()] == ["run fewer tasks at once"]


def test_benchmark_summary(spark):
    rows = [("x", float(i), "success" if i % 10 else "failed") for i in range(100)] + [("y", 500.0, "success"), ("z", None, "success")]
    df = spark.createDataFrame(rows, "operation_type string, duration_ms double, status string")
    base = spark.createDataFrame([("x", 49.0), ("y", 100.0)], "operation_type string, mean double")
    got = {r.operation_type: r for r in metrics.benchmark_summary(df, baseline=base).collect()}
    assert (got["x"].p50, got["x"].p95, got["x"].success_rate, got["x"].target_met, got["x"].regression) == (50.0, 95.0, 0.9, True, False)
    assert got["y"].regression and not got["y"].target_met and got["z"].samples == 0
    assert sorted(tuple(r) for r in metrics.benchmark_problems(metrics.benchmark_summary(df, baseline=base)).collect()) == [("x", "low success"), ("y", "regression"), ("y", "target missed")]


def test_memory_regressions(spark):
    side = lambda m: spark.createDataFrame([("a", 1.0, 0.1, 1.0, m)], "operation_type string, mean double, deviation double, success_rate double, memory double")
    assert [(r.kind, r.severity) for r in metrics.regressions(side(160.0), side(100.0)).collect()] == [("memory", "major")]
    assert metrics.regressions(side(110.0), side(100.0)).count() == 0


def test_report_of_an_empty_period(spark):
    df = spark.createDataFrame([], "operation_type string, duration_ms double, started_at timestamp, memory_peak_mb double, cpu_usage_percent double")
    assert {r.section for r in metrics.performance_report(df, None, None).collect()} == {"resources", "health"}


def test_eviction_policies(spark):
    rows = [("a", 10, 5, 100, 7.0), ("b", 500, 50, 3, None), ("c", 1, 1, 50, 900.0), ("d", 20, 2, None, 30.0)]
    df = spark.createDataFrame(rows, "key string, age long, uses long, ttl_left long, next_use double")
    gone = lambda p: sorted(r.key for r in caches.evicted(df, p, 2).collect())
    assert gone("lru") == ["b", "d"] and gone("lfu") == ["c", "d"] and gone("ttl") == ["b", "d"] and gone("predicted") == ["b", "c"]
    assert len(gone("blend")) == 2
    with pytest.raises(ValueError):
        gone("other")
    uses = spark.createDataFrame([("i", 0), ("i", 10), ("i", 20), ("j", 5)], "item string, at long")
    assert {r["item"]: r.next_use for r in caches.next_use(uses, "item", "at", F.lit(25)).collect()} == {"i": 5.0, "j": None}


def test_best_references(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 6))
    ids = [f"k{i:03d}" for i in range(120)]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x)], "id string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    taken = set()
    for a in range(120):
        if a not in taken:
            taken |= {b for b in range(a + 1, 120) if s[a, b] >= 0.8}
    want = {ids[b]: ids[max((a for a in range(120) if a not in taken), key=lambda a: (s[a, b], -a))] for b in taken}
    assert {r.id: r.reference for r in dedup.best_references(df, 0.8).collect()} == want


def test_pool_of_shared_delta_and_raw(spark):
    base, far = [0.5, 0.1, 0.0, 0.4], [0.0, 1.0, 0.0, 0.0]
    rows = [("1", base), ("2", base), ("3", [0.5, 0.11, 0.0, 0.41]), ("4", far), ("5", None), ("6", [50.0, 10.0, 0.0, 40.0])]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    held, shared = compression.pool_encoded(df, 0.95)
    assert shared.count() == 4 and {r.kind for r in shared.collect()} == {"raw", "delta"}
    back = {r.id: r.vector for r in compression.pool_decoded(held, shared).collect()}
    for i, v in rows:
        assert back[i] is None if v is None else np.allclose(back[i], v, atol=0.01 * max(v))
    held, shared = compression.pool_encoded(df.limit(0), 0.95)
    assert compression.pool_decoded(held, shared).count() == 0


def test_equal_vectors_share_their_reference(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [1.0, 0.01]), ("d", [1.0, 0.0]), ("e", [0.0, 0.0]), ("f", None)], "id string, vector array<double>")
    got = {r.id: r.reference for r in compression.delta_encoded(df, 0.9).collect()}
    assert got == {"a": None, "b": "a", "c": "a", "d": "a", "e": None, "f": None}


def test_windows_end_with_sentences():
    text = "Dr. Smith came in. He sat down!  Then he left the room again, slowly.\n\nA new paragraph begins here and goes on for a while."
    parts = chunking.adjusted(text, 40, 0, 5)
    assert parts[0] == "Dr. Smith came in. He sat down!" and all(len(p) <= 40 for p in parts)
    assert chunking.adjusted("i.e. " * 30, 40, 5, 1)[0] == ("i.e. " * 8).strip()  # abbreviations end nothing
    assert chunking.adjusted(text, 80, 0, 5)[0].endswith("slowly.")
    assert chunking.adjusted("", 40, 0) == [] and chunking.adjusted("tiny", 40, 0) == ["tiny"] and chunking.adjusted(" " * 50, 40, 0) == []
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab .!\n") for _ in range(r.randrange(200)))
        size, overlap = r.randrange(20, 60), r.randrange(0, 19)
        got = chunking.adjusted(t, size, overlap, 1)
        assert all(p in t and len(p) <= size for p in got)
        assert "".join("".join(chunking.adjusted(t, size, 0, 1)).split()) == "".join(t.split())


def test_adjusted_windows_of_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 50)], "k int, t string")
    assert [r.w for r in df.select("k", chunking.adjusted_windows(F.col("t"), 20, 5).alias("w")).orderBy("k").collect()] == [None, [], ["x" * 20, "x" * 20, "x" * 20]]


def test_code_blocks_are_not_cut():
    text = ("word " * 30 + "\n```\n" + "code\n" * 30 + "```\n") * 3
    ends = [e for _, e in chunking.chunks_of(text, chunking.ChunkConfig("markdown_aware", 200, 0, 10))]
    blocks = [(e["start"], e["end"]) for e in markdown.elements(text) if e["kind"] == "code"]
    assert len(blocks) == 3 and any(e == z for e in ends for _, z in blocks)


GOLDEN = "# Title\n\nSome *text* with [a link](http://x \"t\") & `code`.\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx < 1\n```\n> quoted\n---\n"
HTML = (
    '<h1>Title</h1>\n<p>Some <em>text</em> with <a href="http://x "t"">a link</a> &amp; <code>code</code>.</p>\n<ul><li>one</li><li>two</li></ul>\n'
    '<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>\n<pre><code class="language-py">x &lt; 1</code></pre>'
)


def test_golden_markdown():
    kinds = [e["kind"] for e in markdown.elements(GOLDEN)]
    assert kinds == ["header", "break", "paragraph", "break", "list", "table", "break", "code", "header", "link"]
    assert markdown.to_html(GOLDEN).startswith(HTML)


def test_heading_paths_are_the_contexts():
    r = random.Random(3)
    text = "\n".join("#" * r.randrange(1, 5) + f" h{i}" if r.random() < 0.3 else "words and more" for i in range(120))
    found, at = markdown.elements(text), list(range(0, len(text), 37))
    assert markdown.heading_paths(found, at) == [[t for _, t in markdown.heading_context(found, p)] for p in at]


def test_scratch_can_be_dropped(spark):
    from notelake.session import drop_scratch, scratch, written

    kept, place = written(spark.range(3).toDF("i"), "kept"), scratch(spark, "gone")
    gone = written(spark.range(5).toDF("i"), "gone", place)
    drop_scratch(place)
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)exist|found"):
        gone.count()


def test_golden_chunks():
    text = "First sentence here. Second one follows it.\n\n" * 12
    cuts = {s: chunking.chunks_of(text, chunking.ChunkConfig(s, 200, 20, 50)) for s in chunking.STRATEGIES}
    assert cuts["fixed_size"][:2] == [(0, 200), (180, 380)]
    assert cuts["semantic"][0] == (0, 180) and cuts["hybrid"][0] == (0, 180)
    assert all(c[-1][1] == len(text) for c in cuts.values())


def test_a_failing_model_is_asked_again_and_then_text_by_text(spark, tmp_path):
    def model(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise OSError("no answer")
        return np.ones((1, 2), np.float32) * len(texts[0])

    df = spark.createDataFrame([("ab",), ("bad",), ("abc",), (None,), (" ",)], "t string").coalesce(1)
    got = [r.v for r in df.select(embedder.embed(F.col("t"), model, 3, str.upper, (0.0,), False).alias("v")).collect()]
    assert got == [[2.0, 2.0], [3.0, 3.0], [3.0, 3.0], None, None]  # the cleaned text is BAD
    got = [r.v for r in df.select(embedder.embed(F.col("t"), model, 3, None, (0.0,), False).alias("v")).collect()]
    assert got[1] is None and got[2] == [3.0, 3.0]
    with pytest.raises(Exception, match="no answer"):
        df.select(embedder.embed(F.col("t"), model, 3, None, (0.0,)).alias("v")).collect()
    assert [embedder.batch_size(p, x, w) for p, x, w in (("high", 0.4, 0), ("low", 0.9, 0), ("normal", 0.1, 0), ("normal", 0.4, 500))] == [5, 10, 20, 20]


@pytest.mark.parametrize("codec", ["gzip", "lz4", "none"])
def test_batch_files_in_every_codec(spark, tmp_path, codec):
    rows = spark.createDataFrame([(str(i), [float(i), 1.0], "f", "m") for i in range(30)], "id string, vector array<float>, file_path string, model_name string")
    full = rows.select("id", "vector", "file_path", F.lit("c").alias("chunk_id"), F.lit("h").alias("text_hash"), F.lit(1).cast("long").alias("text_length"), F.lit("p").alias("content_preview"), "model_name", F.lit(None).cast("map<string,string>").alias("custom_metadata"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    batches.write_batches(full, str(tmp_path / "b"), codec, 10)
    assert sorted(r.id for r in batches.read_batches(spark, str(tmp_path / "b")).collect()) == sorted(str(i) for i in range(30))
    assert maintenance.compressed(spark, str(tmp_path / "b"), str(tmp_path / "z"), "lz4") == 30


def test_rebuild(spark, tmp_path):
    texts = spark.createDataFrame([("a.md", "1", "one two"), ("a.md", "2", "one two"), ("b.md", "1", None), ("c.md", "1", "three")] + [(f"{i}.md", "1", f"note {i}") for i in range(20)], "file_path string, chunk_id string, content string")
    vectors = lambda bad: lambda df: df.select("content", F.when(~F.col("content").isin(*bad), F.array(F.lit(1.0), F.length("content").cast("double"))).alias("vector"))
    store = VersionedStore(spark, str(tmp_path / "s"))
    got = maintenance.rebuild(store, texts, vectors(["three"]), "m", 7)
    assert (got["rows"], got["failed"]) == (22, 1) and store.read().count() == 22
    with pytest.raises(ValueError):
        maintenance.rebuild(store, texts, vectors([f"note {i}" for i in range(20)]), "m", 7)
    assert store.read().count() == 22


def test_optimise_compresses(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.publish(spark.createDataFrame([("a", [1.0, 0.0], 1, 1, 5), ("b", [1.0, 0.001], 1, 2, 5), ("c", [0.0, 1.0], 1, 1, 5)], "id string, vector array<float>, created_at long, updated_at long, text_length long"))
    assert maintenance.optimise(store, 0.95, 1, 8)["removed"] == 1
    rows = {r.id: r for r in store.read().collect()}
    assert set(rows) == {"b", "c"} and rows["c"].codes == [0, 255]
    old = spark.createDataFrame([("x.json", 0), ("y.json", 200_000), ("z.json.gz", 0)], "path string, modified long")
    assert [r.path for r in maintenance.to_compress(old, 200_000).collect()] == ["x.json"]


def test_approximate_search_has_a_recall(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    config, hits = search.SearchConfig(k=10, min_threshold=-1.0), 0
    for q in range(8):
        exact = set(np.argsort(-(u @ u[q]))[:10])
        hits += len(exact & {row.id for row in search.approximate_top_k(df, [float(y) for y in x[q]], config, F.col("id"), seed=q).collect()})
    share = max(min(int(10 * math.sqrt(4000)), 4000), 100) / 4000  # rows that are drawn
    assert share * 0.4 < hits / 80 < share * 2  # a hit is found if it is drawn


def test_monitored_search(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "id string, vector array<double>")
    hits, row = search.monitored_top_k(df, [1.0, 0.1], search.SearchConfig(min_threshold=0.5), target_ms=1e9)
    m = row.first()
    assert [h.id for h in hits.collect()] == ["a"] and m.results == 1 and m.searched == 3 and m.target_met and m.duration_ms > 0
