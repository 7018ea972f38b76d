"""The change feed and the references between tables, against plain Python."""

import random
import unicodedata

import pytest

from notelake.operators import changes as C
from notelake.operators import orphans as O

FEED = "record_id long, change_type string, file_path string, moved_to string, detected_at long, watch_seq long, content_hash string, bucket string, kind string"


def plain(p):
    return None if p is None else unicodedata.normalize("NFC", "/".join(s for s in p.replace("\\", "/").split("/") if s not in ("", ".")))


def brute(rows):
    seen, hashes = {}, {}
    for _, kind, path, to, at, seq, h, *_ in rows:
        kind = {"removed": "deleted", "renamed": "moved"}.get(kind.strip().lower(), kind.strip().lower()) if kind else None
        if path is None or at is None or kind not in ("created", "modified", "deleted", "moved"):
            continue
        at, seq, path, to = at // 1000 if at >= 10**11 else at, -1 if seq is None else seq, plain(path), plain(to)
        events = [(path, kind in ("created", "modified"), 0, None if kind == "moved" else h)]
        if kind == "moved" and to is not None:
            events.append((to, True, 1, h))
        for p, alive, step, hh in events:
            seen[p] = max(seen.get(p, (-1,)), (at, seq, step, alive))
            if hh is not None:
                hashes[p] = max(hashes.get(p, (-1,)), (at, seq, step, hh))
    return {(p, hashes[p][3] if p in hashes else None) for p, s in seen.items() if s[3]}


def feed(n, seed):
    r = random.Random(seed)
    names = ["a/b.md", "./a//b.md", "a\\b.md", "café.md", "café.md", "x/y.md", "z.md", None]
    rows = []
    for i in range(n):
        at = 1_750_000_000 + r.randrange(40)
        rows.append((i, r.choice(["created", " Modified", "deleted", "removed", "MOVED", "renamed", "odd", None]), r.choice(names), r.choice(names), r.choice([at, at, at * 1000 + 7, None]),
                     r.choice([None, *range(5)]), r.choice([None, "h1", "h2", "h3"]), "clash", "clash"))
    return rows + [x for x in rows if r.random() < 0.3]


@pytest.mark.parametrize("seed", range(4))
def test_feed_in_any_order_with_repeats(spark, seed):
    rows = feed(300, seed)
    want = brute(rows)
    for k in range(2):
        random.Random(k).shuffle(rows)
        df = spark.createDataFrame(rows, FEED).repartition(3)
        assert set(map(tuple, C.current_files(C.apply_changes(C.path_events(df), buckets=3)).collect())) == want


def test_feed_partial_states_may_be_cut_anywhere(spark):
    from functools import partial

    rows = feed(400, 9)
    events = C.path_events(spark.createDataFrame(rows, FEED))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        local = events.mapInArrow(partial(C._upsert, memory_mb=128, flush_rows=50), C.STATE).repartition(1).mapInArrow(partial(C._upsert, memory_mb=128, flush_rows=None), C.STATE)
        assert set(map(tuple, C.current_files(local).collect())) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_feed_one_path_has_most_changes_and_empty_feed(spark):
    rows = [(i, "modified", "hot.md", None, 1_750_000_000 + i // 3, i % 3, f"{i}", "", "") for i in range(3000)]
    assert C.current_files(C.apply_changes(C.path_events(spark.createDataFrame(rows, FEED).repartition(4)))).collect() == [("hot.md", "2999")]
    assert C.apply_changes(C.path_events(spark.createDataFrame([], FEED))).count() == 0


def test_move_onto_itself_keeps_the_file(spark):
    rows = [(1, "created", "a", None, 10, 1, "x", "", ""), (2, "moved", "a", "./a", 11, 1, None, "", "")]
    assert C.current_files(C.apply_changes(C.path_events(spark.createDataFrame(rows, FEED)))).collect() == [("a", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_integer_orphans(spark, seed):
    r = random.Random(seed)
    parents = [(r.randrange(-50, 5000),) for _ in range(3000)] + [(None,)]
    refs = [(r.choice([None, r.randrange(-80, 6000)]),) for _ in range(2000)] + [(7,)] * 500
    got = {x[0] for x in O.integer_orphans(spark.createDataFrame(refs, "k long"), spark.createDataFrame(parents, "k long"), "k", width=300).collect()}
    assert got == {x[0] for x in refs if x[0] is not None} - {x[0] for x in parents}


def test_integer_orphans_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "k long"), spark.createDataFrame([(1,), (1,)], "k long")
    assert O.integer_orphans(none, some, "k").count() == 0
    assert O.integer_orphans(some, none, "k").collect() == [(1,)]


def test_runs_are_maximal(spark):
    got = O.runs(spark.createDataFrame([(0, x) for x in (1, 2, 3, 7, 9, 10)], "p int, k long"), ["p"], "k").collect()
    assert sorted((r.run_start, r.run_end) for r in got) == [(1, 3), (7, 7), (9, 10)]


REF = "ref_table string, ref_field string, ref_id string, universe string, missing_key string, period string, bucket int, rank int"


def test_orphan_references(spark):
    refs = [("t", "f", "1", "u", "a", "2024-01", 1, 1), ("t", "f", "1", "u", "a", "2024-01", 1, 1), ("t", "f", "2", "u", "b", "2024-01", 1, 1), ("t", "f", "3", "u", None, None, 1, 1), ("t", "f", "4", "v", "b", None, 1, 1)]
    refs += [("t", "f", str(i), "u", "hot", "2024-02", 1, 1) for i in range(500)]
    parents = [("u", "b"), ("u", None), ("w", "a"), ("u", "zz")]
    got = O.orphan_references(spark.createDataFrame(refs, REF).drop("bucket", "rank"), spark.createDataFrame(parents, "universe string, missing_key string"))
    assert sorted((r.ref_id, r.missing_key) for r in got.collect() if r.missing_key != "hot") == [("1", "a"), ("4", "b")]
    assert got.where("missing_key = 'hot'").count() == 500


def test_month_is_utc(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0,), (1709251199,), (1709251200,), (-1,), (None,)], "s long")
    assert [r[0] for r in rows.select(O.month(F.col("s"))).collect()] == ["1970-01", "2024-02", "2024-03", "1969-12", None]


def test_latest_listing_prefers_the_latest_row(spark):
    rows = [("./a", "a", 1, 1, False, False, 1), ("a", "a", 1, 1, False, True, 2), ("b", "b", 1, None, True, None, 1), (None, "c", 1, 1, False, False, 3)]
    df = spark.createDataFrame(rows, "path string, name string, modified long, size long, is_dir boolean, is_deleted boolean, listed_at long")
    assert sorted((r.path, r.is_deleted) for r in O.latest_listing(df).collect()) == [("a", True), ("b", None)]
