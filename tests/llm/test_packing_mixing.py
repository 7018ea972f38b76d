"""Packing and mixing: plans on counts, exact sums, whole results."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import mixing as M
from notelake.llm import packing as P
from notelake.llm.ranks import salted_rank


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=17, max_size=17))
def test_every_item_is_packed_once_and_none_overflows(counts):
    counts = np.array(counts)
    counts[0] = 0
    got = np.zeros(17, np.int64)
    for members, times in P.fit(counts, sampled=200):
        assert sum(members) <= 16 and times > 0
        np.add.at(got, list(members), times)
    assert (got == counts).all()


def test_nnls_against_the_optimum():
    r = np.random.default_rng(0)
    a, x = r.random((30, 12)), np.maximum(r.normal(size=12), 0)
    assert np.allclose(P.nnls(a, a @ x), x, atol=1e-8)
    b = r.normal(size=30)
    got = P.nnls(a, b)
    gradient = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gradient <= 1e-6).all() and np.allclose(gradient[got > 0], 0, atol=1e-6)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("container", "rank", "class", "piece", "tokens", "_salt")})


def test_pack_frame(spark):
    r = random.Random(4)
    rows = [(i, "é" * r.randrange(0, 900)) for i in range(600)] + [(900, "x" * 20_001), (901, "漢" * 9_000), (902, None), (903, ""), (904, "y" * 8192), (905, "y" * 8193)] + [(1000 + i, "s" * 1000) for i in range(400)]
    packed = P.pack(docs(spark, rows)).collect()
    pieces, fill = {}, {}
    for p in packed:
        pieces.setdefault(p.doc_id, []).append(p)
        fill[p.container] = fill.get(p.container, 0) + p.tokens
    assert set(pieces) == {i for i, _ in rows} and max(fill.values()) <= 8192
    for i, text in rows:
        data, mine = (text or "").encode(), sorted(pieces[i], key=lambda p: p.piece)
        assert b"".join(data[p.start : p.start + p.tokens] for p in mine) == data
        assert len(mine) == mine[0].pieces and (len(mine) == 1) == (len(data) <= 8192)
        for p in mine:
            data[p.start : p.start + p.tokens].decode()  # no character is cut
    total = sum(len((t or "").encode()) for _, t in rows)
    assert len(fill) <= total / 8192 * 1.08 + 2
    assert P.pack(docs(spark, [])).count() == 0
    assert {p.container for p in packed if p.tokens == 0} == {0}


def test_repeated_rows_are_items_of_their_own(spark):
    packed = P.pack(docs(spark, [(1, "x" * 5000)] * 7))
    assert P.pack(docs(spark, [(None, "x" * 5000), (None, "y" * 9000), (1, "z")])).count() == 4
    assert packed.count() == 7 and packed.groupBy("container").agg(F.sum("tokens").alias("n")).where("n > 8192").count() == 0


def test_salted_rank(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i % 50) for i in range(900)], "g string, i int")
    got = salted_rank(df, ["g"], F.xxhash64("i"), ["i"], salts=7).groupBy("g").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"), F.count(F.lit(1)).alias("n"))
    assert got.where("lo <> 0 or hi <> n - 1 or d <> n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 200))
def test_subset_sum_is_the_best(have, budget):
    lengths, counts = np.array(sorted(have), np.int64), np.array([have[k] for k in sorted(have)], np.int64)
    take = M.subset_sum(lengths, counts, budget)
    best = {0}
    for length, n in have.items():
        best = {s + length * k for s in best for k in range(n + 1) if s + length * k <= budget}
    assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() == max(best)


def test_fit_budget_is_near_and_seeded():
    r = np.random.default_rng(1)
    lengths, counts = np.arange(0, 3000), r.integers(0, 9, 3000)
    for budget in (0, 1, 77_777, 5_000_000, 10**9):
        take = M.fit_budget(lengths, counts, budget, 5)
        total = int((lengths * counts).sum())
        assert (take <= counts).all() and (take * lengths).sum() == min(budget, total) or budget == 10**9
        assert (take == M.fit_budget(lengths, counts, budget, 5)).all()


def test_fit_budget_with_long_documents():
    lengths = np.array([80_000, 90_000, 100_000])
    assert (M.fit_budget(lengths, np.ones(3, np.int64), 170_000, 1) == [1, 1, 0]).all()
    assert (M.fit_budget(np.array([90_000, 100_000]), np.full(2, 20), 1_000_000, 1) * [90_000, 100_000]).sum() == 1_000_000
    assert (M.fit_budget(np.array([100, 900_000]), np.array([1500, 4]), 800_000, 3) == [1500, 0]).all()  # nothing that fits is left out


TARGET = "mix_id int, source string, weight double, max_repeats int, size_factor double, tokens long, rank int"


def test_mix_frame(spark):
    r = random.Random(2)
    names = ["web", " Web", "WEB", "notes-x", "notes_x", "Notes X", None, "rare"]
    rows = [(i, r.choice(names[:7]), "w" * r.randrange(0, 300)) for i in range(900)] + [(2000, "rare", "abc"), (2001, "rare", None), (None, "web", "null id")] + [(3000 + i, "web", "h" * 100) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("tokens", "rank", "times")})
    t = [(1, "web", 3.0, 2, 1.5, 0, 0), (1, "notes_x", 1.0, 3, 1.5, 0, 0), (2, "rare", 1.0, 4, 0.5, 0, 0), (2, "none", 1.0, 4, 0.5, 0, 0), (3, "web", None, 1, 1.0, 0, 0), (1, "web", 3.0, 2, 1.5, 0, 0), (4, "web", 0.0, 1, 1.0, 0, 0), (None, "web", 1.0, 1, 1.0, 0, 0)]
    targets = spark.createDataFrame(t, TARGET)
    report = {(x.mix_id, x.source): x for x in M.report(M.plan(d, targets)).collect()}
    assert set(report) == {(1, "web"), (1, "notes_x"), (2, "rare"), (2, "none"), (4, "web")}
    total = sum(len(x or "") for _, _, x in rows)
    assert abs(report[1, "notes_x"].target_tokens - 0.25 * 1.5 * total) < 1e-6
    assert report[2, "none"].cannot_reach and report[2, "rare"].cannot_reach and report[2, "rare"].reached_tokens == 12
    assert not report[1, "notes_x"].cannot_reach and 0 <= report[1, "notes_x"].target_tokens - report[1, "notes_x"].reached_tokens < 1
    mixed = M.mix(d, targets)
    got = {(x.mix_id, x.source): x.n for x in mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("n")).collect()}
    assert all(got.get(k, 0) == x.reached_tokens for k, x in report.items())
    assert mixed.join(targets.select("mix_id", "source", "max_repeats").distinct(), ["mix_id", "source"]).where("times > max_repeats").count() == 0
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert M.mix(d.limit(0), targets).count() == 0 and M.report(M.plan(d, targets.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["p6_found", "p7_found", "p3_found"])
def test_found_queries(spark, data, name):
    from notelake.llm import queries as Q

    assert Q.QUERIES[name](spark, data).count() >= 0
