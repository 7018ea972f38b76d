"""Queries do their whole job: all rows are written, and the method named is the one that decides."""

from pyspark.sql import functions as F

from notelake.operators import orphans
from notelake.plans import files
from notelake.session import load


def test_all_models_pass_through_the_batch_files(spark, data):
    want = load(spark, data, "embedding_entry").where("id is not null").groupBy("model_name").count()
    got = files.batch_files_roundtrip(spark, data).select("model_name", "entries")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_the_match_is_given_stored_references_too(spark, monkeypatch):
    seen = []
    real = orphans.beyond_runs
    monkeypatch.setattr(orphans, "beyond_runs", lambda references, *rest: seen.append(references) or real(references, *rest))
    rows = lambda keys: spark.createDataFrame([("u", k) for k in keys], "universe string, missing_key string")
    found = orphans.orphan_references(rows(["a", "b", "c", "c", "e", None]), rows(["a", "b", "d", None])).select(F.col("missing_key")).collect()
    assert sorted(r[0] for r in found) == ["c", "e"]
    assert sorted(r.missing_key for r in seen[0].collect()) == ["a", "b", "c", "e"]
