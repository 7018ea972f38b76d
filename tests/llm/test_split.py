"""Splitting: sizes, overlaps, whole texts, natural boundaries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import split as S

texts = st.text(alphabet=st.sampled_from(list("abc .!?\n\r,`#-é漢") + ["👩", "‍", "🏽", "🇩", "🇪", "́"]), max_size=900)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 120), st.integers(0, 60))
def test_pieces(text, size, overlap):
    parts = S.pieces(text, size, overlap)
    used = max(0, min(overlap, size - 1))
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(e - s <= size for s, e in parts)
    assert all(s == max(0, e - used) for (_, e), (s, _) in zip(parts, parts[1:]))
    assert all(a[1] < b[1] for a, b in zip(parts, parts[1:]))
    assert (len(parts) == 1) == (len(text) <= size)


def test_weak_boundaries_are_thought_of_beside_strong_ones():
    at, _ = S._boundaries("aa bb.\ncc dd. ee, ff gg" * 40, 100)
    assert {3, 7, 10, 14, 18, 21} <= set(at.tolist())


def test_long_signs_stay_whole_where_steps_are_even():
    text = "👩\u200d👩\u200d👧" * 60
    parts = S.pieces(text, 23, 0)
    assert all((s % 5, e % 5) == (0, 0) for s, e in parts) and parts[-1][1] == len(text)


def test_of_a_repeated_configuration_the_greatest_sizes_hold(spark):
    chunks = spark.createDataFrame([(1, "a b " * 20, 7)], "chunk_key long, content string, config_id int")
    configs = spark.createDataFrame([(7, 20, 3), (7, 40, 5), (7, None, 9)], "config_id int, max_chunk_size int, overlap_size int")
    assert {r.overlap for r in S.split(chunks, configs).where("piece > 0").collect()} == {5}


def brute(text, size, overlap):
    """Cost of the best cut over all subsets of the boundaries that are thought of."""
    reach = size - overlap
    at, price = S._boundaries(text, reach)
    n = len(text)
    number = 1 + -(-(n - size) // reach)
    ideal = (n - overlap) / number
    at, price = [int(a) for a in at], [float(p) for p in price]
    best = {0: 0.0}
    for p, cost in [*zip(at, price), (n, 0.0)]:
        options = [v + ((p - (q or overlap) - ideal) / reach) ** 2 for q, v in best.items() if q < p and p - q <= (size if q == 0 else reach)]
        if options:
            best[p] = min(options) + cost
    return best.get(n)


def cost(text, size, overlap, ends):
    reach = size - overlap
    at, price = S._boundaries(text, reach)
    costs = dict(zip(map(int, at), map(float, price)))
    number = 1 + -(-(len(text) - size) // reach)
    ideal, total, last = (len(text) - overlap) / number, 0.0, 0
    for e in [*ends, len(text)]:
        total += ((e - (last or overlap) - ideal) / reach) ** 2 + costs.get(e, 0.0)
        last = e
    return total


@pytest.mark.parametrize("size, overlap", [(80, 0), (80, 20), (120, 30)])
def test_cuts_are_the_cheapest(size, overlap):
    text = "One sentence here. Another, longer one follows!\n\nA paragraph of words without an end, going on and on\n- item\n- item two? Yes.\n" * 4
    want = brute(text, size, overlap)
    assert want is not None and abs(cost(text, size, overlap, S.cuts(text, size, overlap)) - want) < 1e-9


def test_natural_boundaries():
    text = ("word " * 15 + "end.\n\n") * 6
    assert all(text[:e].endswith("\n\n") for _, e in S.pieces(text, 200, 0))
    family = "👨‍👩‍👧‍👦" * 40
    for _, e in S.pieces(family, 50, 0)[:-1]:
        assert not S._joined(family, e)


def test_frame(spark):
    rows = [(1, "word " * 100, 1, "x"), (2, None, 1, "x"), (3, " " * 300, 1, "x"), (4, "short", 1, "x"), (5, "y" * 500, 9, "x"), (6, "z" * 500, 2, "x"), (7, "l" * 400_000, 1, "x"), (8, "word " * 100, 1, "x"), (9, "", 1, "x"), (None, "n" * 300, 1, "x"), (2**60 + 1, "m" * 300, 1, "x"), (10, "q" * 300, None, "x")]
    chunks = spark.createDataFrame(rows, "chunk_key long, content string, config_id int, text string")
    configs = spark.createDataFrame([(1, 200, 20, "clash"), (2, None, None, "clash"), (1, 200, 20, "clash")], "config_id int, max_chunk_size int, overlap_size int, chunk_key string")
    out = S.split(chunks, configs)
    assert sorted(r.chunk_key for r in S.oversized(out).collect() if r.chunk_key is not None) == [1, 3, 7, 8, 2**60 + 1]
    assert out.where("length(text) > 200 and chunk_key not in (5, 6, 10)").count() == 0
    assert out.where("chunk_key = 2").first().text is None and out.where("chunk_key in (2, 4, 5, 6, 9)").count() == 5
    assert out.where("piece > 0 and overlap <> 20").count() == 0
    assert out.where("chunk_key = 7").selectExpr("sum(length(text)) - sum(overlap) as n").first().n == 400_000
    assert S.split(chunks.limit(0), configs).count() == 0
