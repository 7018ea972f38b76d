"""A move ends one path and makes another exist, in the batch and in the stream."""

import os

from notelake.plans import entries, streams
from notelake.session import load

CHANGES = "record_id long, change_type string, file_path string, moved_to string, detected_at long, watch_seq long"


def folder_with(spark, data, path, changes):
    for table in ("embedding_entry", "note_chunk", "documents"):
        os.symlink(f"{data}/{table}.parquet", path / f"{table}.parquet")
    spark.createDataFrame(changes, CHANGES).write.parquet(str(path / "change_record.parquet"))
    return str(path)


def test_moves_in_the_batch(spark, data, tmp_path):
    chunks = load(spark, data, "note_chunk").where("file_path is not null")
    paths = [r[0] for r in chunks.join(entries._live(spark, data), "file_path", "left_semi").select("file_path").distinct().orderBy("file_path").limit(4).collect()]
    a, b, c, d = paths
    folder = folder_with(spark, data, tmp_path, [(1, " Renamed", a, b, 10, 1), (2, "moved", c, c, 10, 2), (3, "created", d, None, 10, 3), (4, "moved", d, None, 11, 4)])
    got = {r.id for r in entries.apply_change_batch(spark, folder).collect()}
    of = lambda p: {str(r[0]) for r in chunks.where(chunks.file_path == p).select("chunk_key").collect()}
    old = {r.id for r in entries._live(spark, data).where(entries.F.col("file_path").isin(paths)).select("id").collect()}
    assert of(b) <= got and of(c) <= got and not got & (of(a) | of(d) | old)


def test_moves_in_the_stream(spark, data, tmp_path):
    a = load(spark, data, "documents").where("file_path is not null").agg(entries.F.min("file_path")).first()[0]
    folder = folder_with(spark, data, tmp_path, [(1, "moved", a, "elsewhere.md", 10, 1)])
    got = {r.file_path: r.id for r in streams.stream_applied_changes(spark, folder).select("id", "file_path").collect()}
    assert a not in got and got["elsewhere.md"] == "new elsewhere.md"
