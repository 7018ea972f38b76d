"""Neighbours and groups of close entries, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import diverse as D
from notelake.llm import neighbours as N
from notelake.operators import cells as C


def unit(x):
    x = np.asarray(x, np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, files=None, model="m", prefix="e"):
    rows = [(f"{prefix}{i:05d}", model, None if files is None else files[i], bytearray(v.tobytes()), "clash", 1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, model_name string, file_path string, unit binary, codes string, block int")


def vectors(n, d=32, seed=0, groups=12, noise=0.15):
    r = np.random.default_rng(seed)
    x = unit(r.normal(size=(n, d)))
    centers = x[:groups]
    for g in range(groups):
        at = r.integers(n // 2, n, 15)
        x[at] = unit(centers[g] + r.normal(size=(15, d)) * noise / np.sqrt(d))
    return x


def test_codebook_errs_less_along_the_vector():
    x = vectors(3000)
    plain, aware = N.Codebook.fit(x), N.Codebook.fit(x)
    plain.weight = 1.0
    along = lambda b: np.abs(np.einsum("ij,ij->i", b.decode(b.encode(x)) - x, x)).mean()
    assert along(aware) < along(plain)
    codes = aware.encode(x[:10])
    assert (N.from_nibbles(N.nibbles(codes)) == codes).all() and codes.max() < 16


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_have_the_recall(spark, seed):
    x = vectors(2500, seed=seed)
    x[100:110] = x[99]
    files = [None if i % 11 == 0 else f"f{i % 7 if i % 3 else 0}" for i in range(len(x))]
    rows = frame(spark, x, files)
    wanted = spark.createDataFrame([(f"e{i:05d}",) for i in range(0, 2500, 20)] + [("none",), (None,), ("e00000",)], "id string")
    got = N.nearest(rows, wanted, 5).collect()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits, total = 0, 0
    for i in range(0, 2500, 20):
        ok = np.array([j != i and (files[i] is None or files[j] is None or files[i] != files[j]) for j in range(len(x))])
        kth = np.sort(s[i][ok])[-5]
        mine = [r for r in got if r["query"] == f"e{i:05d}"]
        assert len(mine) == 5 and all(ok[int(r.id[1:])] for r in mine)
        assert all(abs(r.similarity - s[i, int(r.id[1:])]) < 1e-6 for r in mine)
        hits += sum(r.similarity >= kth - 1e-7 for r in mine)
        total += 5
    assert hits / total >= 0.98
    assert {(r.entry_a < r.entry_b) for r in N.pairs(N.nearest(rows, wanted, 5)).collect()} == {True}


def test_neighbours_of_small_and_empty_tables(spark):
    x = vectors(3, groups=0)
    rows = frame(spark, x, ["a", "a", "b"])
    everyone = rows.select("id")
    got = {(r["query"], r.id) for r in N.nearest(rows, everyone, 5).collect()}
    assert got == {("e00000", "e00002"), ("e00001", "e00002"), ("e00002", "e00000"), ("e00002", "e00001")}
    assert N.nearest(rows.limit(0), everyone, 5).count() == 0
    assert N.nearest(rows, everyone.limit(0), 5).count() == 0
    two = rows.unionByName(frame(spark, vectors(2, 16, groups=0), ["z", "y"], "other", "o"))
    assert {r.id[0] for r in N.nearest(two, two.select("id"), 5).where("query like 'o%'").collect()} == {"o"}


def groups(x, threshold):
    n, label = len(x), list(range(len(x)))
    s = x.astype(np.float64) @ x.astype(np.float64).T

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in zip(*np.nonzero(s >= threshold)):
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {(f"e{find(i):05d}", f"e{i:05d}") for i in range(n) if find(i) != i}


@pytest.mark.parametrize("block_rows,many", [(12_288, 64), (40, 64), (100, 4)])
def test_close_groups(spark, monkeypatch, block_rows, many):
    monkeypatch.setattr(D, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(D, "MANY_BLOCKS", many)
    x = vectors(1500, seed=4)
    r = np.random.default_rng(1)
    x[600:1100] = unit(x[7] + r.normal(size=(500, 32)) * 0.1 / np.sqrt(32))  # a third of the rows are one group
    x[1200:1210] = x[1199]
    chain = [x[20]]
    for _ in range(8):  # connected only through others
        chain.append(unit([chain[-1] + r.normal(size=32) * 0.22 / np.sqrt(32)])[0])
    x[1300:1309] = chain
    want = groups(x, 0.95)
    got = D.close_groups(frame(spark, x), 0.95).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def test_clustered_vectors_visit_few_blocks():
    r = np.random.default_rng(5)
    middle = unit(r.normal(size=(40, 64)))
    x = unit(middle[r.integers(0, 40, 60_000)] + r.normal(size=(60_000, 64)) * 0.2 / 8)
    units = C.centers_of(x[::20], 40, middle)
    cell = C.nearest_center(x, units)
    least = np.array([(x[cell == c] @ units[c]).min(initial=1.0) for c in range(40)])
    plan = D.Plan(units, np.bincount(cell, minlength=40), least, 0.95)
    cell = C.nearest_center(x, plan.units)
    home = plan.home(cell, r.integers(-(2**62), 2**62, len(x)))
    assert plan.blocks == 5 and np.bincount(home).max() < 1.1 * len(x) / 5
    assert plan.visits(x, cell, home).sum() < 0.25 * 2 * len(x)  # of the two other blocks that an entry could visit


def test_near_cells_hold_all_partners():
    r = np.random.default_rng(8)
    x = unit(r.normal(size=(4000, 24)) * np.linspace(2, 0.2, 24))
    units = C.centers_of(x[::4], 60)
    cell = C.nearest_center(x, units)
    least = np.array([(x[cell == c] @ units[c]).min(initial=1.0) for c in range(60)])
    plan = D.Plan(units, np.bincount(cell, minlength=60), least, 0.95)
    cell = C.nearest_center(x, plan.units)
    near = plan.near(x, cell)
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert near[a, cell[b]].all() and near.mean() < 0.6


def test_outlines_bound_the_cosine():
    x = vectors(500, d=64, seed=3)
    o = D.outline(x, D.basis(x[:60]))
    assert o.shape[1] == 17 and (o @ o.T >= x @ x.T - 1e-5).all()


def test_short_rows_stay_within_their_error():
    x = vectors(300, seed=2)
    short = D.Short.of(x)
    again = D.Short.unpacked(pa.array(short.packed()))
    off = np.linalg.norm(again.rows().astype(np.float64) - x, axis=1)
    assert (off <= again.error + 1e-7).all() and again.error.max() < 1e-4
    assert len(D.Short.joined([short, again])) == 600


def test_sets_merge_many_pairs_at_once():
    r = np.random.default_rng(0)
    pairs = r.integers(0, 300, (200, 2))
    sets = D._Sets(300)
    sets.merge(pairs[:100, 0], pairs[:100, 1])
    sets.merge(pairs[100:, 0], pairs[100:, 1])
    label = list(range(300))
    for a, b in pairs:
        a, b = label[a], label[b]
        label = [min(a, b) if v in (a, b) else v for v in label]
    assert sets.find(np.arange(300)).tolist() == label


def test_close_groups_edges(spark):
    x = vectors(5, groups=0)
    assert D.close_groups(frame(spark, x), 0.999).count() == 0
    assert D.close_groups(frame(spark, x), None).count() == 0
    assert D.close_groups(frame(spark, x).limit(0), 0.9).count() == 0
    same = np.repeat(x[:1], 4, axis=0)
    assert sorted(map(tuple, D.close_groups(frame(spark, same), 0.95).collect())) == [("e00000", f"e0000{i}") for i in (1, 2, 3)]


@pytest.mark.parametrize("few", [20_000, 0])
def test_links_near_the_threshold_are_decided_exactly(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    a = np.zeros((2, 8), np.float32)
    for cos, linked in ((0.95001, True), (0.94999, False), (0.9500004, True), (0.9499996, False)):
        a[0, 0], a[1, 0], a[1, 1] = 1, cos, np.sqrt(1 - cos * cos)
        assert (D.close_groups(frame(spark, unit(a)), 0.95).count() == 1) is linked


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(-10**17, 10**17, (40, 2))] + [(i, i + 1) for i in range(60)] + [(5000, i) for i in range(100, 400)] + [(7, 7)]
    label = {}

    def find(v):
        while label.setdefault(v, v) != v:
            v = label[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    want = {(find(v), v) for v in label if find(v) != v}
    assert set(map(tuple, D.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert D.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_varied_subset(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 200)
    x = unit(np.eye(16)[np.array([0] * 900 + list(range(16)) * 5)] + np.random.default_rng(0).normal(size=(980, 16)) * 0.01)
    got = D.varied_subset(frame(spark, x), 16, 0.9).orderBy("place").collect()
    kinds = {int(x[int(r.id[1:])].argmax()) for r in got}
    assert len(got) == 16 and kinds == set(range(16))  # one of each kind, though one kind has nine tenths
    assert [r.id for r in D.varied_subset(frame(spark, x), 16, 0.9).orderBy("place").collect()] == [r.id for r in got]
    more = D.varied_subset(frame(spark, x), 40, 0.9).orderBy("place").collect()
    assert len(more) == 40 and [r.crowded for r in more] == [False] * 16 + [True] * 24
    assert all(a.similarity_before <= b.similarity_before + 1e-6 for a, b in zip(more[1:], more[2:]))
    with pytest.raises(ValueError):
        monkeypatch.setattr(D, "POOL_ROWS", 30)
        D.varied_subset(frame(spark, x), 40)
    assert D.varied_subset(frame(spark, x[:3]), 10).count() == 3
    assert D.varied_subset(frame(spark, x).limit(0), 10).count() == 0


def test_coverage(spark):
    x = vectors(400, seed=8)
    chosen = {r.id for r in D.varied_subset(frame(spark, x), 25).collect()}
    got = D.covered(frame(spark, x), 25).collect()
    at = sorted(int(i[1:]) for i in chosen)
    s = x.astype(np.float64) @ x[at].astype(np.float64).T
    assert len(got) == 400 and {r.representative for r in got} <= chosen
    assert all(abs(r.similarity - s[int(r.id[1:])].max()) < 1e-5 for r in got)
    assert D.covered(frame(spark, x).limit(0), 5).count() == 0


def test_pool_is_thinned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 100)
    monkeypatch.setattr(D, "POOL_ROWS", 150)
    x = vectors(1500, seed=6)
    got = D.varied_subset(frame(spark, x).repartition(8), 20).orderBy("place").collect()
    assert len(got) == 20 and max(r.similarity_before for r in got if r.place) < 0.5


def test_every_part_proposes_as_many_as_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 100)
    monkeypatch.setattr(D, "POOL_ROWS", 600)
    r = np.random.default_rng(2)
    kinds = np.concatenate([np.arange(60), np.zeros(4000, int)])  # all but one kind lie in the first part
    x = unit(np.eye(64)[kinds] + r.normal(size=(len(kinds), 64)) * 0.005)
    few = frame(spark, vectors(50, groups=0), model="small", prefix="s")  # a second model in one part
    got = D.varied_subset(frame(spark, x).coalesce(1).unionByName(few.coalesce(1)), 60).collect()
    assert {int(kinds[int(g.id[1:])]) for g in got if g.model_name == "m"} == set(range(60))
    assert sum(g.model_name == "small" for g in got) == 50


def test_close_pairs_of_spread_vectors_are_all_found(spark, monkeypatch):
    r = np.random.default_rng(12)
    x = unit(r.normal(size=(12_000, 128)))
    e = r.normal(size=(6000, 128))
    e = unit(e - (e * x[:6000]).sum(1, keepdims=True) * x[:6000])
    x[6000:] = unit(x[:6000] * 0.951 + e * np.sqrt(1 - 0.951**2))  # sets of two, most of them far from any representative
    got = {tuple(g) for g in D.close_groups(frame(spark, x), 0.95).collect()}
    assert got == {(f"e{i:05d}", f"e{i + 6000:05d}") for i in range(6000)}


def index(x, cells=1, probes=1):
    units = C.centers_of(x, cells)
    cell = C.nearest_center(x, units)
    layout = C.Layout(units, np.bincount(cell, minlength=cells), np.ones(cells), 10**9, 1, 1)
    return N.Index(N.Codebook.fit(x), layout, probes, 0), C.nearest_center(x, layout.units)


def block(ids, x, k, path=None, **options):
    i, cell = index(x, **options)
    return N._Block(i, [(ids, np.zeros(len(x), np.int64) if path is None else path, x, N.nibbles(i.book.encode(x)), cell)], k)


def test_ties_of_many_copies_go_to_the_least_ids():
    x = vectors(300, groups=0)
    x[100:] = x[100]
    ids = [f"e{i:05d}" for i in range(300)][::-1]  # the least ids come last
    found = list(block(ids, x, 5).search(np.array(["q"], object), np.zeros(1, np.int64), x[100:101]))
    assert sorted(i for f in found for i in f[1]) == [f"e{i:05d}" for i in range(5)]


def test_a_query_takes_no_place_among_its_own_neighbours():
    d = 32
    x = np.zeros((40, d), np.float32)
    x[0, 0] = 1
    for i, c in enumerate((0.97, 0.96, 0.96, 0.95, 0.6), 1):
        x[i, 0], x[i, i] = c, np.sqrt(1 - c * c)
    x[6:, 6:] = np.random.default_rng(1).normal(size=(34, d - 6))
    x = unit(x)
    b = block([f"e{i:05d}" for i in range(40)], x, 5)
    b.scan, b.book.margin = lambda s, e: x[s:e], 0.1
    assert (b.ids == [f"e{i:05d}" for i in range(40)]).all()
    (q, found, _), = b.search(np.array(["e00000"], object), np.zeros(1, np.int64), x[:1])
    assert sorted(found) == [f"e{i:05d}" for i in range(1, 6)]


@pytest.mark.parametrize("cells", [1, 20])
def test_a_block_of_many_tiles_keeps_the_best(monkeypatch, cells):
    monkeypatch.setattr(N, "TILE", (7, 96))
    monkeypatch.setattr(N, "GROUPS", 8)
    monkeypatch.setattr(N, "WAITING", 50)
    x = vectors(1003, seed=9)
    x[500:700] = x[3]
    ids, path = np.array([f"e{i:05d}" for i in range(1003)], object), np.arange(1003) % 9
    b = block(list(ids), x, 6, path, cells=cells, probes=cells)
    got = {}
    for q, found, similarity in b.search(ids[:60], path[:60], x[:60]):
        for i, j, s in zip(q, found, similarity):
            got.setdefault(i, []).append((-s, j))
    exact, hits = x.astype(np.float64) @ x.astype(np.float64).T, 0
    for i in range(60):
        want = sorted((-exact[i, j], ids[j]) for j in range(1003) if j != i and (path[i] == 0 or path[i] != path[j]))[:6]
        hits += len({w[1] for w in want} & {g[1] for g in got[ids[i]]})
        if i == 3:
            assert sorted(g[1] for g in got[ids[i]]) == sorted(w[1] for w in want)
    assert hits >= 0.99 * 360


def test_clustered_queries_visit_few_cells():
    r = np.random.default_rng(7)
    middle = unit(r.normal(size=(60, 32)))
    x = unit(middle[r.integers(0, 60, 6000)] + r.normal(size=(6000, 32)) * 0.4 / np.sqrt(32))
    units = C.centers_of(x, 77)
    few = N.probes_for(x, units, 5)
    assert few < 30
    cell = C.nearest_center(x, units)
    i = N.Index(N.Codebook.fit(x[:500]), C.Layout(units, np.bincount(cell, minlength=77), np.ones(77), 500, 4, 1), few, 0)
    s = x[::10] @ x.T
    s[np.arange(600), np.arange(0, 6000, 10)] = -2
    best = np.argsort(-s, axis=1)[:, :5]
    seen = np.take_along_axis(i.visited(x[::10]), C.nearest_center(x, i.layout.units)[best], axis=1)
    assert seen.mean() >= 0.98 and i.visited(x[::10]).mean() < 0.5
    assert N.probes_for(x[:10], units[:3], 5) == 3
