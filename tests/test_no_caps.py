"""What runs in rounds, slices or buckets gives the same as the whole would."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import caches, cells, dedup, metrics, ordered, search
from notelake.sources.store import BucketedStore


def greedy(pairs):
    taken = set()
    for a, b in sorted(pairs):
        if a not in taken:
            taken.add(b)
    return taken


@pytest.mark.parametrize("few", [0, 3, 2_000_000])
def test_every_pair_is_settled_however_long_the_chain(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW_PAIRS", few)
    r = random.Random(few)
    pairs = {tuple(sorted((f"k{r.randrange(60):03d}", f"k{r.randrange(60):03d}"))) for _ in range(150)}
    pairs = {p for p in pairs if p[0] != p[1]} | {(f"m{i:03d}", f"m{i + 1:03d}") for i in range(11 if few == 0 else 200)}
    got = [x.id for x in dedup.taken_ids(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(pairs)
    assert dedup.taken_ids(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_chain_of_two_hundred_vectors(spark):
    x = [(f"v{i:03d}", [1.0 if j in (i, i + 1) else 0.0 for j in range(201)]) for i in range(200)]  # each is close to its neighbours only
    got = dedup.greedy_clusters(spark.createDataFrame(x, "id string, vector array<float>"), 0.45).collect()
    assert {(g.seed, g.member) for g in got} == {(f"v{i - 1:03d}", f"v{i:03d}") for i in range(1, 200, 2)}


def test_percentiles_of_slices_are_those_of_the_whole(spark):
    r = random.Random(4)
    values = [(k, float(v)) for k, n in (("a", 3000), ("b", 7), (None, 40)) for v in (r.choice([5, 5, 5, r.randrange(2000)]) for _ in range(n))] + [("c", None)]
    got = {x.k: x for x in metrics.index_percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v", (0, 50, 95, 99), slices=5).collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"].samples == 0 and got["c"].p50 is None
    for k in ("a", "b", None):
        s = sorted(v for g, v in values if g == k)
        assert [got[k][f"p{p}"] for p in (0, 50, 95, 99)] == [s[len(s) * p // 100] for p in (0, 50, 95, 99)]


def test_moving_average_feels_all_values(spark):
    r = random.Random(2)
    values = [r.random() * 100 for _ in range(900)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("one", 0, 7.0), ("k", 1000, None)], "k string, t int, v double")
    for alpha in (0.001, 0.3, 1.0):
        want = values[0]
        for v in values[1:]:
            want = want * (1 - alpha) + v * alpha
        got = {x.k: x.average for x in metrics.moving_average(df, "k", "v", ["t"], alpha).collect()}
        assert abs(got["k"] - want) < 1e-9 and got["one"] == 7.0
    with pytest.raises(ValueError):
        metrics.moving_average(df, "k", "v", ["t"], 0.0)


def test_bucketed_store_rewrites_what_is_touched(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), 8, "k")
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)] + [(None, -1)], "k string, v int")
    assert store.publish(rows) == 1 and store.read().count() == 101
    b = rows.where("k = 'k7'").select(store.bucket().alias("b")).first().b
    mine = store.read([b])
    assert 0 < mine.count() < 101
    store.publish(mine.where("k <> 'k7'").withColumn("v", F.lit(-5)), [b])
    got = {x.k: x.v for x in store.read().collect()}
    assert "k7" not in got and len(got) == 100 and all((v == -5) == (k in {x.k for x in mine.collect()}) or k is None for k, v in got.items())
    assert store.retain() == []
    store.publish(rows)
    assert store.retain() == [1, 2]
    with pytest.raises(ValueError):
        store.publish(rows, [b])
    store.publish(rows.limit(0), [b])  # a bucket may become empty
    assert store.read([b]).count() == 0 and store.read().count() < 101


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_ordered_computations_across_slices(spark, monkeypatch, slices):
    monkeypatch.setattr(ordered, "SLICES", slices)
    r = random.Random(slices)
    rows = [(i, r.choice(["hot", "hot", "u", None]), r.randrange(400), r.choice("abc"), float(r.randrange(5))) for i in range(600)] + [(1000, "one", 5, "a", 1.0), (1001, "hot", None, "b", 2.0)]
    df = spark.createDataFrame(rows, "request_id long, user string, t long, item string, v double").withColumn("at", F.timestamp_seconds("t"))
    groups = {}
    for i, u, t, item, v in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
        groups.setdefault(u, []).append((i, t, item, v))
    follow, near, close, runs, served = {}, {}, {}, {}, {}
    for u, g in groups.items():
        run = best = 0
        for j, (i, t, item, v) in enumerate(g):
            if j:
                follow[g[j - 1][2], item] = follow.get((g[j - 1][2], item), 0) + 1
            for x in g[max(0, j - 4) : j]:
                if x[2] != item:
                    near[x[2], item] = near.get((x[2], item), 0) + 1
                    if x[1] is not None and t - x[1] <= 2:
                        close[x[2], item] = close.get((x[2], item), 0) + 1
            run = run + 1 if j and v > g[j - 1][3] else 0
            best = max(best, run)
            served[i] = i if not j or t is None or g[j - 1][1] is None or t - g[j - 1][1] > 3 else served[g[j - 1][0]]
        runs[u] = best
    at = ["at", "request_id"]
    table = lambda d: {(x[0], x[1]): x[2] for x in d.collect()}
    assert table(metrics.transitions(df, "user", "item", at)) == follow
    assert table(metrics.co_access(df, "user", "item", at)) == near
    assert table(metrics.co_access(df, "user", "item", at, seconds=2)) == close
    assert {x.user: x.longest_growth for x in metrics.growth_runs(df, "user", "v", at).collect()} == runs
    assert {x.request_id: x.served_by for x in caches.deduplicated_requests(df, ["user"], "at", 3).collect()} == served
    assert metrics.growth_runs(df.limit(0), "user", "v", at).count() == 0 and metrics.transitions(df.limit(0), "user", "item", at).count() == 0


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_search_by_cells_is_exact(spark, monkeypatch, spread):
    r = np.random.default_rng(6)
    x = r.normal(size=(30, 8))[r.integers(0, 30, 1200)] + r.normal(size=(1200, 8)) * spread / 3
    x[100:130] = x[99] * 2
    rows = [(f"e{i:04d}", [float(v) for v in a]) for i, a in enumerate(x)] + [("bad", [0.0] * 8), ("none", None), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    some = df.where("id < 'e0200'")
    table = lambda d: {(t.query, t.id): round(t.similarity, 9) for t in d.collect()}
    want = [table(search.block_search(some, df, 7, 0.1)), table(search.block_search(some, df, None, 0.95)), table(search.block_search(df, df, None, 0.97))]
    monkeypatch.setattr(search, "CELLS_FROM", 10)
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    assert [table(search.block_search(some, df, 7, 0.1)), table(search.block_search(some, df, None, 0.95)), table(search.block_search(df, df, None, 0.97))] == want
    assert search.cell_search(some, df.limit(0), 3).count() == 0 and search.cell_search(df.limit(0), df, None, 0.9).count() == 0


def test_clustered_queries_visit_few_blocks():
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 32))[r.integers(0, 60, 6000)] + r.normal(size=(6000, 32)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    units = cells.centers_of(x[::3], 77)
    cell = cells.nearest_center(x, units)
    least = np.array([(x[cell == c] @ units[c]).min(initial=1.0) for c in range(77)])
    near = cells.may_reach(x, units[cell], units, least, 0.9)
    assert near.mean() < 0.25 and near[np.arange(6000), cell].all()
