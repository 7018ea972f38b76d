"""Vector kernels, search, deduplication, compression."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.functions import vectors as V
from notelake.operators import compression as Z
from notelake.operators import dedup as D
from notelake.operators import search as S
from notelake.operators.entries import usable_entries


def frame(spark, x, start=0):
    return spark.createDataFrame([(f"{i + start:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, vector array<float>")


def gaussian(n, d=16, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def cosines(a, b):
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


CASES = [([1, 0, 0], [1, 0, 0], 1.0), ([1, 0, 0], [0, 1, 0], 0.0), ([1, 0, 0], [-1, 0, 0], -1.0), ([1, 1, 0], [1, 0, 0], 0.7071068), ([3, 4], [4, 3], 0.96), ([], [], None), ([0, 0], [1, 1], None),
         ([float("nan"), 1], [1, 1], None), ([float("inf"), 1], [1, 1], None), ([1], [1, 2], None), (None, [1], None)]


def test_cosine_closed_forms(spark):
    rows = spark.createDataFrame([(i, a and [float(x) for x in a] if a else a, [float(x) for x in b]) for i, (a, b, _) in enumerate(CASES)], "i int, a array<float>, b array<float>")
    got = rows.orderBy("i").select(V.cosine(F.col("a"), F.col("b")), V.storage_cosine(F.col("a"), F.col("b"))).collect()
    for (s, t), (_, _, want) in zip(got, CASES):
        assert (s is None or np.isnan(s)) if want is None else abs(s - want) < 1e-6
        assert abs(t - (want or 0)) < 1e-6 or np.isnan(t)


def test_top_k_and_plan(spark):
    x = gaussian(300)
    hits = S.top_k(frame(spark, x), [float(a) for a in x[0]], S.SearchConfig(k=7, min_threshold=-1.0))
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()
    want = np.argsort(-cosines(x[:1], x)[0], kind="stable")[:7]
    assert [r.id for r in hits.collect()] == [f"{i:04d}" for i in want]


def test_bad_rows_and_parameters(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0]), ("f", [1.0]), (None, [1.0, 0.1]), ("a", [1.0, 0.0])], "id string, vector array<float>")
    assert [r.id for r in S.top_k(rows, [1.0, 0.0], S.SearchConfig(k=5, min_threshold=0.5)).collect()] == ["a", "a", None]
    assert S.top_k(rows.limit(0), [1.0], S.ENGINE).count() == 0
    for bad in ([], [0.0], [float("nan")]):
        with pytest.raises(ValueError):
            S.checked_query(bad)
    with pytest.raises(ValueError):
        S.SearchConfig(k=0).check()
    with pytest.raises(ValueError):
        S.check_engine(0.5, 51)


def test_block_search_is_exact(spark):
    x = gaussian(400, seed=3)
    x[50] = x[51]
    sims = cosines(x[:30], x)
    got = S.block_search(frame(spark, x[:30]), frame(spark, x), 5).collect()
    assert len(got) == 150
    for q in range(30):
        order = sorted(range(400), key=lambda j: (-round(float(sims[q, j]), 12), j))[:5]
        mine = [r.id for r in sorted((r for r in got if r["query"] == f"{q:04d}"), key=lambda r: r["rank"])]
        assert [round(float(sims[q, int(i)]), 9) for i in mine] == [round(float(sims[q, j]), 9) for j in order]
    pairs = {(r["query"], r["id"]) for r in S.block_search(frame(spark, x[:30]), frame(spark, x), None, 0.5).collect()}
    assert pairs == {(f"{i:04d}", f"{j:04d}") for i, j in zip(*np.nonzero(sims >= 0.5))}
    assert S.block_search(frame(spark, x[:3]), frame(spark, x[:0]), 5).count() == 0


def test_diversity_against_plain_greedy(spark):
    x = gaussian(40, 4, 5)
    sims = cosines(x[:1], x)[0]
    hits = frame(spark, x).withColumn("query", F.lit("q")).withColumn("similarity", F.lit(0.0))
    table = spark.createDataFrame([(f"{i:04d}", float(s)) for i, s in enumerate(sims)], "id string, s double")
    got = S.diverse(hits.join(table, "id").select("query", "id", F.col("s").alias("similarity"), "vector"), 0.6, 6)
    c, kept = cosines(x, x), []
    for i in np.argsort(-sims, kind="stable"):
        if all(c[i, j] < 0.6 for j in kept):
            kept.append(i)
        if len(kept) == 6:
            break
    assert [r.id for r in got.orderBy("rank").collect()] == [f"{i:04d}" for i in kept]


def test_recency_all_of_one_age_is_unchanged(spark):
    rows = spark.createDataFrame([("a", 0.5, 10), ("b", 0.9, 10)], "id string, similarity double, updated_at long")
    assert sorted(r.similarity for r in S.recency_weighted(rows, 0.3).collect()) == [0.5, 0.9]
    rows = spark.createDataFrame([("a", 0.5, 10), ("b", 0.9, 20), ("c", 0.2, None)], "id string, similarity double, updated_at long")
    assert sorted(round(r.similarity, 6) for r in S.recency_weighted(rows, 0.3).collect()) == [0.2, 0.5, 1.0]


def test_approximate_falls_back_to_exact(spark):
    x = gaussian(1200, 8, 1)
    q = [float(a) for a in x[0]]
    config = S.SearchConfig(k=10, min_threshold=0.93, max_results=10)
    rows = frame(spark, x)
    exact = {r.id for r in S.top_k(rows, q, config).collect()}
    assert {r.id for r in S.approximate_top_k(rows, q, config, F.col("id").cast("long")).collect()} == exact


def greedy(x, threshold):
    c, free, out = cosines(x, x), set(range(len(x))), {}
    for i in range(len(x)):
        if i in free:
            free.discard(i)
            for j in sorted(free):
                if c[i, j] >= threshold:
                    out[f"{j:04d}"] = f"{i:04d}"
            free -= {int(k) for k in out}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_clusters(spark, seed):
    r = np.random.default_rng(seed)
    x = gaussian(150, 6, seed)
    x[60:90] = x[r.integers(0, 60, 30)] + r.normal(size=(30, 6)).astype(np.float32) * 0.25
    x[100:110] = x[5]
    got = D.greedy_clusters(frame(spark, x), 0.9)
    want = greedy(x, 0.9)
    assert {r.member: r.seed for r in got.collect()} == want
    rows = frame(spark, x).withColumn("created_at", F.col("id").cast("long")).withColumn("updated_at", F.lit(1).cast("long")).withColumn("text_length", F.lit(None).cast("long"))
    for strategy in ("most_recent", "earliest", "longest_content"):
        mapping = D.reference_mapping(got, D.representatives(got, rows, strategy))
        assert D.broken_references(rows, D.without(rows, mapping), mapping).count() == 0
        assert mapping.count() == len(want)


def test_exact_duplicates(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}" if i % 3 == 1 else None) for i in range(300)] + [(0, "hot")], "doc_id long, text string")
    mapping = D.exact_mapping(rows, ["text"], "doc_id")
    assert mapping.count() == 99 and mapping.select("representative").distinct().collect() == [(0,)]
    assert D.without(rows, mapping, "doc_id").select("doc_id").distinct().count() == 201


@pytest.mark.parametrize("bits", [8, 16])
def test_quantization_roundtrip(spark, bits):
    x = np.vstack([gaussian(40), np.full((1, 16), 0.5, np.float32), np.zeros((1, 16), np.float32)])
    assert Z.roundtrip_error(frame(spark, x), "vector", bits).where("not within").count() == 0
    empty = spark.createDataFrame([("a", []), ("b", None)], "id string, vector array<float>")
    assert Z.roundtrip_error(empty, "vector", bits).where("max_error is not null").count() == 0


def test_delta_roundtrip(spark):
    x = gaussian(80, 8, 2)
    x[40:60] = x[:20] * 1.01
    rows = frame(spark, x)
    code = Z.delta_encoded(rows, 0.9)
    assert code.where("reference is not null").count() >= 20
    back = {r.id: r for r in Z.delta_decoded(code).collect()}
    for i, v in enumerate(x):
        r = back[f"{i:04d}"]
        assert np.abs(np.array(r.decoded) - v).max() <= r.scale * 0.51 + 1e-6


def test_pool(spark):
    rows = frame(spark, np.repeat(gaussian(5), 4, axis=0))
    shared = Z.pool(rows)
    assert shared.count() == 5
    assert Z.unpooled(Z.pooled(rows), shared).join(rows.withColumnRenamed("vector", "v"), "id").where("vector <> v").count() == 0


def test_usable_entries(spark):
    good, zero = [1.0] * 64, [0.0] * 64
    rows = [("a", good, "./x", 1, "quill-embed-xs"), ("a", zero, "x", 2, "quill-embed-xs"), ("b", good, "a\\b", 5, "quill-embed-xs"), ("b", None, None, 4, "quill-embed-xs"), ("c", good, None, None, "quill-embed-xs"),
            ("d", good, "q", 1, "quill-embed-s"), ("e", [float("nan")] + good[1:], "q", 1, "quill-embed-xs"), (None, good, "q", 1, "quill-embed-xs"), ("f", good, "q", 1, None), ("b", good, "a\\b", 5, "quill-embed-xs")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id string, vector array<float>, file_path string, updated_at long, model_name string, unit int, r string")
    got = {r.id: r for r in usable_entries(df).collect()}
    assert set(got) == {"b", "c"} and got["b"].file_path == "a/b" and got["c"].file_path is None
    assert abs(np.frombuffer(got["b"].unit, np.float32) - 0.125).max() < 1e-6
    assert usable_entries(df.limit(0)).count() == 0
