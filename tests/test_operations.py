"""Metrics, maintenance, caches, sources, store, streaming, and the driver's contract."""

import json
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import caches, lookup, maintenance, metrics
from notelake.sources import batches, embedder, vault
from notelake.sources.store import VersionedStore
from notelake.streaming import changes as stream

OPS = "event_id long, operation_type string, started_at timestamp, duration_ms double"


def ops(spark, n=500, seed=0):
    r = random.Random(seed)
    rows = [(i, r.choice("abc"), float(r.randrange(40)) if r.random() < 0.9 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, operation_type string, duration_ms double").withColumn("started_at", F.timestamp_seconds(F.col("event_id") * 60))


def test_index_percentiles(spark):
    rows, df = ops(spark)
    for r in metrics.index_percentiles(df, "operation_type", "duration_ms").collect():
        v = sorted(x for _, k, x in rows if k == r.operation_type and x is not None)
        assert (r.p50, r.p95, r.p99) == tuple(v[len(v) * p // 100] for p in (50, 95, 99))
        assert abs(r.deviation - statistics.pstdev(v)) < 1e-9
    hundred = spark.createDataFrame([("x", float(i)) for i in range(100)], "k string, v double")
    assert metrics.index_percentiles(hundred, "k", "v").first().p95 == 95.0


def test_trends(spark):
    rise = spark.createDataFrame([("up", i, v) for i, v in enumerate((10.0, 12.0, 14.0, 16.0))] + [("down", i, v) for i, v in enumerate((16.0, 14.0, 12.0, 10.0))] + [("flat", i, v) for i, v in enumerate((10.0, 10.1, 9.9, 10.0))] + [("few", 0, 1.0)], "k string, t int, v double")
    got = {r.k: (None if r.slope is None else round(r.slope, 3), r.direction) for r in metrics.trend(rise, "k", "v", ["t"]).collect()}
    assert got["up"] == (2.0, "degrading") and got["down"] == (-2.0, "improving") and got["flat"][1] == "stable" and got["few"][1] == "stable"


def test_moving_average(spark):
    r = random.Random(3)
    v = [r.random() for _ in range(50)]
    want = v[0]
    for x in v[1:]:
        want = want * 0.8 + x * 0.2
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, t int, v double")
    assert abs(metrics.moving_average(df, "k", "v", ["t"], 0.2).first().average - want) < 1e-9


def test_growth_runs(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((1, 2, 3, 4, 2, 3))] + [("b", i, v) for i, v in enumerate((3, 2, 2, 1))], "k string, t int, v int")
    assert {r.k: (r.longest_growth, r.leak) for r in metrics.growth_runs(df, "k", "v", ["t"]).collect()} == {"a": (3, True), "b": (0, False)}


def test_severity_and_health(spark):
    df = spark.createDataFrame([(25.0,), (30.0,), (50.0,), (-120.0,)], "c double")
    assert [r[0] for r in df.select(metrics.severity(F.col("c"))).collect()] == ["minor", "moderate", "major", "critical"]
    assert metrics.index_health(10_000, 10, 10_000 * 4096)["status"] == "healthy"
    assert metrics.index_health(10_000, 14, 10_000 * 4096)["status"] == "warning"
    assert metrics.index_health(10_000, 20, 10_000 * 40960)["status"] == "critical"
    assert metrics.index_health(0, 0, 0)["efficiency"] == 1.0
    assert metrics.establish_baseline(lambda: 5.0)["samples"] == 10
    empty = spark.createDataFrame([], OPS)
    assert metrics.average_metrics(empty).count() == 0 and metrics.baselines(empty).count() == 0
    assert metrics.health_score(metrics.average_metrics(empty), 10, 10).first().score == 1.0


def test_live_view_is_order_independent(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "x"), (None, 5, "n"), ("a", 3, "z")]
    schema = "id string, updated_at long, v string"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert sorted(map(tuple, lookup.live(spark.createDataFrame(rows, schema)).collect())) == [("a", 3, "z"), ("b", None, "x")]


def test_paging(spark):
    df = spark.range(25)
    assert [(r.id, r.has_more) for r in lookup.page(df, 2, 10, "id").collect()] == [(i, False) for i in range(20, 25)]
    assert all(r.has_more for r in lookup.page(df, 0, 10, "id").collect())
    assert lookup.page(df, 9, 10, "id").count() == 0


def test_validation(spark):
    schema = "id string, file_path string, chunk_id string, model_name string, text_hash string, text_length long, vector array<float>"
    good = ("i", "p", "c", "m", "h" * 64, 1, [1.0])
    bad = [(None, " ", "", None, "h", 0, None), ("i", "p", "c", "m", "h" * 64, 1, [float("inf")])]
    ok, out = lookup.quarantine(spark.createDataFrame([good, *bad], schema))
    assert ok.count() == 1
    assert sorted(sorted(r.problems) for r in out.collect()) == [["chunk_id", "file_path", "id", "model_name", "text_hash", "text_length", "vector_empty"], ["vector_not_finite"]]


def test_maintenance(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "id string, file_path string")
    assert maintenance.delete_files(rows, spark.createDataFrame([("a",), (None,)], "file_path string")).count() == 2
    fresh = spark.createDataFrame([("9", "a"), ("8", "c")], "id string, file_path string")
    assert sorted(r.id for r in maintenance.replace_files(rows, fresh).collect()) == ["3", "4", "8", "9"]
    changes = spark.createDataFrame([("a", "deleted", 1), ("b", "modified", 1), ("c", "created", 2), ("a", "created", 0)], "file_path string, change_type string, at int")
    last = maintenance.latest_changes(changes, "file_path", ["at"], "change_type")
    new = spark.createDataFrame([("7", "b"), ("6", "c"), ("5", "a")], "id string, file_path string")
    assert sorted(r.id for r in maintenance.apply_batch(rows, last, new).collect()) == ["4", "6", "7"]
    assert maintenance.integrity(rows, spark.createDataFrame([("1",), ("x",)], "id string")).first() == (1, 3, 1)
    assert maintenance.should_compact(60, 100, 25) and not maintenance.should_compact(60, 100, 1)
    assert maintenance.should_optimise(7, 0, 0.3, 0) == "size" and maintenance.should_optimise(1, 9999, 1, 1) is None
    files = [("a.tmp", 0), ("b.tmp", 9_000), ("c.lock", 9_000), ("d.log", 0), ("e.md", 0)] + [(f"backup_{i:02d}", i) for i in range(13)]
    gone = maintenance.expired(spark.createDataFrame(files, "path string, modified long"), 10_000)
    assert sorted(r.path for r in gone.collect()) == ["a.tmp", "backup_00", "backup_01", "backup_02", "c.lock"]


def test_caches(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "r int, key string")
    hits, misses = caches.split_hits(req, spark.createDataFrame([("a", 7)], "key string, v int"), "key")
    assert [tuple(r) for r in hits.collect()] == [("a", 1, 7)] and sorted(r.r for r in misses.collect()) == [2, 3]
    c = spark.createDataFrame([(i, i * 100) for i in range(6)], "k int, cached_at long")
    assert caches.fresh(c, 500, 300).count() == 3
    assert sorted(r.k for r in caches.least_recent(c, 4, "cached_at", "k").collect()) == [0, 1]


def test_store_publishes_atomically(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    for i in range(1, 5):
        assert store.publish(spark.range(i)) == i
    assert store.read().count() == 4
    os.makedirs(tmp_path / "s" / "v=9")  # a write that never finished
    assert store.versions() == [1, 2, 3, 4]
    store.rollback(2)
    assert store.read().count() == 2 and store.retain(1) == [1, 3]
    with pytest.raises(ValueError):
        store.rollback(3)
    assert spark.read.parquet(store.backup(str(tmp_path / "b"))).count() == 2


def test_maintenance_cycle_and_optimise(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(30, 8))
    x[20:] = x[:10]
    rows = spark.createDataFrame([(f"{i:02d}", [float(a) for a in v], i, i, i) for i, v in enumerate(x)], "id string, vector array<float>, created_at long, updated_at long, text_length long")
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.publish(rows)
    assert maintenance.optimise(store)["removed"] == 10
    assert maintenance.maintenance_cycle(store, spark.createDataFrame([("11",), ("12",)], "id string"))["removed"] == 2
    assert store.read().count() == 18
    report = maintenance.health_report(store.read())
    assert report["entries"] == 18 and report["files"] == 1


def test_batch_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}", [float(i)], "p", "c", "h", 1, "x", "m", {"a": "b"}, 1, 2) for i in range(25)], batches.ENTRY)
    batches.write_batches(rows, str(tmp_path / "b"), rows_per_file=10)
    back = batches.read_batches(spark, str(tmp_path / "b"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert batches.read_headers(spark, str(tmp_path / "b")).agg(F.sum("entries")).first()[0] == 25
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.json").write_text(json.dumps({"header": {"major": 2, "minor": 0}, "entries": [{"id": "1"}]}))
    assert batches.read_batches(spark, str(tmp_path / "n")).count() == 0


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "vault"
    for p, t in {"a.md": "one", "sub/b.md": "two", "sub/deep/c 10.md": "", "sub/deep/c 9.md": "four", "skip.txt": "x"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return str(root)


def test_vault_scan(spark, tree):
    files = vault.scan(spark, tree)
    assert sorted((r.path, r.is_dir) for r in files.collect()) == [("a.md", False), ("sub", True), ("sub/b.md", False), ("sub/deep", True), ("sub/deep/c 10.md", False), ("sub/deep/c 9.md", False)]
    assert vault.statistics(files).first() == (4, 2, 10)
    assert [r["name"] for r in vault.tree(files).where("parent = 'sub/deep'").orderBy("place").collect()] == ["c 9.md", "c 10.md"]
    assert {r.path: r.text for r in vault.read_notes(spark, tree).collect()}["sub/b.md"] == "two"
    after = files.where("path <> 'a.md'").unionByName(spark.createDataFrame([("n.md", "n.md", 1, 1, False)], files.schema))
    assert sorted(map(tuple, vault.snapshot_changes(files, after).collect())) == [("a.md", "deleted"), ("n.md", "created")]


def test_embedder(spark):
    model = embedder.hash_embedder(8)
    df = spark.createDataFrame([(1, "hello world"), (2, " "), (3, None), (4, "hello world"), (5, "x" * 9000)], "i int, text string")
    out = {r.i: r.vector for r in df.select("i", embedder.embed(F.col("text"), model).alias("vector")).collect()}
    assert out[1] == out[4] and abs(sum(x * x for x in out[1]) - 1) < 1e-6 and out[2] is out[3] is out[5] is None
    cache = df.where("i = 1").select(F.sha2("text", 256).alias("key"), F.array(F.lit(9.0).cast("float")).alias("vector"))
    got = {r.i: r.vector for r in embedder.embed_with_cache(df, cache, model).collect()}
    assert got[1] == got[4] == [9.0] and got[3] is None and len(got) == 5


def test_streams(spark, tmp_path, tree):
    notes = stream.note_stream(spark, tree, excluded=("sub/deep",))
    q = notes.writeStream.format("memory").queryName("notes").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("notes").collect()) == ["a.md", "sub/b.md"]

    schema = "file_path string, change_type string, at long, record_id long"
    feed = tmp_path / "feed"
    spark.createDataFrame([("a.md", "created", 1, 1), ("b.md", "created", 1, 2), ("b.md", "deleted", 2, 3), ("x.png", "created", 1, 4)], schema).coalesce(1).write.parquet(str(feed))
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.publish(spark.createDataFrame([("old", "b.md"), ("keep", "z.md")], "id string, file_path string"))
    fresh = lambda last: last.select(F.concat(F.lit("new-"), "file_path").alias("id"), "file_path")
    for _ in range(2):  # nothing new the second time
        stream.apply_stream(stream.change_stream(spark, str(feed), schema), store, fresh, str(tmp_path / "c2"), ["at", "record_id"]).awaitTermination()
    assert sorted(r.id for r in store.read().collect()) == ["keep", "new-a.md"] and store.current() == 2


def test_debounce_and_bursts(spark, tmp_path):
    schema = "path string, kind string, at timestamp"
    rows = [("a", "created", 0.0), ("a", "modified", 0.5), ("a", "modified", 0.9), ("a", "deleted", 5.0), ("b", "created", 0.1), ("end", "x", 100.0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "path string, kind string, s double").selectExpr("path", "kind", "timestamp_micros(cast(s * 1000000 as long)) as at").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    q = stream.debounced(read(), "path", "at").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.kind, r.changes) for r in spark.table("bursts").collect()) == [("a", "deleted", 1), ("a", "modified", 3), ("b", "created", 1)]
    q = stream.first_requests(read(), ["path"], "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.path for r in spark.table("firsts").collect()} == {"a", "b", "end"}
    timed = read().selectExpr("path as operation_type", "at as started_at", "1.0 as duration_ms")
    q = stream.windowed_metrics(timed).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.operation_type: r.operations for r in spark.table("hours").collect()} == {"a": 4, "b": 1, "end": 1}


def test_filters_reach_the_scan(spark, data):
    rows = spark.read.parquet(f"{data}/embedding_entry.parquet").where(F.col("model_name") == "quill-embed-xs").select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model_name,quill-embed-xs)" in plan and "vector" not in plan


def test_contract(spark, data):
    import __spark_entry__ as E

    queries = E.queries()
    assert set(E.oracle_sql()) <= set(queries)
    out = E.entry(spark)
    assert out.count() == 10 and out.columns == ["id", "model_name", "file_path", "similarity", "rank"]
    for name in ("p2_found", "p5_report", "chunk_semantic", "hourly_trends", "folder_tree"):
        assert queries[name](spark, data).count() > 0
