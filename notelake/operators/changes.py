"""Applying a change feed: per-bucket embedded DuckDB upserts with stored sequences and tombstones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.paths import plain_path
from notelake.session import written

#: today's names of change types and the two older ones.
CHANGE_TYPES = {"created": "created", "modified": "modified", "deleted": "deleted", "moved": "moved", "removed": "deleted", "renamed": "moved"}
#: Epoch values beyond this are milliseconds (as seconds it is the year 5138).
MILLISECONDS_FROM = 100_000_000_000

#: Rows of folded states that one bucket takes in: its database holds no more paths than that and needs no disk.
BUCKET_ROWS = 250_000

STATE = "file_path string, alive boolean, seen_at long, seen_seq long, seen_step int, content_hash string, hash_at long, hash_seq long, hash_step int"


def whole_seconds(at: Column) -> Column:
    """Epoch seconds, rounded down, of values some of which are milliseconds."""
    return F.when(at >= MILLISECONDS_FROM, F.floor(at / 1000)).otherwise(at).cast("long")


def change_kind(change_type: Column) -> Column:
    """Canonical change type; null if unknown."""
    plain = F.lower(F.trim(change_type))
    out = F.lit(None).cast("string")
    for name, kind in CHANGE_TYPES.items():
        out = F.when(plain == name, kind).otherwise(out)
    return out


def path_events(changes: DataFrame) -> DataFrame:
    """One row per path that a change touches: the sequence (second, counter, step), whether it exists after, the hash recorded.

    A move ends ``file_path`` (step 0) and then makes ``moved_to`` exist (step 1), so a move onto itself leaves the file.
    Rows without path, time or known type are void; a null counter sorts first; a hash of a move belongs to ``moved_to``.
    """
    kind = change_kind(F.col("change_type"))
    base = changes.select(
        kind.alias("kind"), plain_path(F.col("file_path")).alias("file_path"), plain_path(F.col("moved_to")).alias("moved_to"),
        whole_seconds(F.col("detected_at")).alias("at"), F.coalesce(F.col("watch_seq").cast("long"), F.lit(-1)).alias("seq"), F.col("content_hash").alias("hash"),
    ).where(F.col("kind").isNotNull() & F.col("file_path").isNotNull() & F.col("at").isNotNull())
    moved = F.col("kind") == "moved"
    own = F.struct(F.col("file_path").alias("path"), ~F.col("kind").isin("deleted", "moved"), F.lit(0).alias("step"), F.when(~moved, F.col("hash")).alias("hash"))
    other = F.struct(F.col("moved_to").alias("path"), F.lit(True), F.lit(1).alias("step"), F.col("hash").alias("hash"))
    event = F.explode(F.when(moved & F.col("moved_to").isNotNull(), F.array(own, other)).otherwise(F.array(own)))
    return base.select("at", "seq", event.alias("e")).select(
        F.col("e.path").alias("file_path"), F.col("e.col2").alias("alive"), F.col("at").alias("seen_at"), F.col("seq").alias("seen_seq"), F.col("e.step").alias("seen_step"),
        F.col("e.hash").alias("content_hash"), *[F.when(F.col("e.hash").isNotNull(), c).alias(n) for c, n in ((F.col("at"), "hash_at"), (F.col("seq"), "hash_seq"), (F.col("e.step"), "hash_step"))],
    )


def _upsert(batches: Iterator[pa.RecordBatch], memory_mb: int, flush_rows: int | None) -> Iterator[pa.RecordBatch]:
    """One embedded database per partition; every batch is upserted by conditional conflict updates.

    With ``flush_rows``, a state of so many paths is handed on and begun anew (for partial folding, which may
    be cut anywhere); without, the partition's state is whole.

    The stored row keeps two sequences: of the last sighting (dead rows stay as tombstones) and of the last recorded
    hash. Of two rows with one sequence the existing file wins, then the greater hash, so any order gives one result.
    """
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": False, "temp_directory": ""})  # never a folder of the machine
    db.execute(
        "CREATE TABLE state (file_path VARCHAR PRIMARY KEY, alive BOOLEAN, seen_at BIGINT, seen_seq BIGINT, seen_step INTEGER, "
        "content_hash VARCHAR, hash_at BIGINT, hash_seq BIGINT, hash_step INTEGER)"
    )
    later = "(excluded.seen_at, excluded.seen_seq, excluded.seen_step, excluded.alive) > (state.seen_at, state.seen_seq, state.seen_step, state.alive)"
    fresher = (
        "(excluded.content_hash IS NOT NULL AND (state.content_hash IS NULL OR "
        "(excluded.hash_at, excluded.hash_seq, excluded.hash_step, excluded.content_hash) > (state.hash_at, state.hash_seq, state.hash_step, state.content_hash)))"
    )
    pick = lambda cond, cols: ", ".join(f"{c} = CASE WHEN {cond} THEN excluded.{c} ELSE state.{c} END" for c in cols)
    statement = (
        "INSERT INTO state SELECT * FROM incoming ON CONFLICT (file_path) DO UPDATE SET "
        + pick(later, ("alive", "seen_at", "seen_seq", "seen_step")) + ", " + pick(fresher, ("content_hash", "hash_at", "hash_seq", "hash_step"))
    )
    # an INSERT may touch a key once: a batch is folded to one row per path by the same two orders before it is upserted
    fold = (
        "SELECT file_path, s.alive, s.seen_at, s.seen_seq, s.seen_step, h.content_hash, h.hash_at, h.hash_seq, h.hash_step FROM ("
        "SELECT file_path, "
        "arg_max({'alive': alive, 'seen_at': seen_at, 'seen_seq': seen_seq, 'seen_step': seen_step}, {'a': seen_at, 'b': seen_seq, 'c': seen_step, 'd': alive}) AS s, "
        "arg_max({'content_hash': content_hash, 'hash_at': hash_at, 'hash_seq': hash_seq, 'hash_step': hash_step}, {'a': hash_at, 'b': hash_seq, 'c': hash_step, 'd': content_hash}) "
        "FILTER (content_hash IS NOT NULL) AS h FROM batch GROUP BY file_path)"
    )
    held = 0
    for b in batches:
        if b.num_rows:
            batch = pa.table(b)  # noqa: F841  read by name in SQL
            db.execute(f"CREATE OR REPLACE TEMP TABLE incoming AS {fold}")
            db.execute(statement)
            held += b.num_rows
            if flush_rows and held >= flush_rows:
                yield from db.sql("SELECT * FROM state").to_arrow_reader(20_000)
                db.execute("TRUNCATE state")
                held = 0
    if held:
        yield from db.sql("SELECT * FROM state").to_arrow_reader(20_000)
    db.close()


def apply_changes(events: DataFrame, buckets: int | None = None, memory_mb: int = 384) -> DataFrame:
    """State table (tombstones included) after all events of :func:`path_events`, in whatever order and however often they came.

    Two rounds of the same upsert: each input partition folds its own rows first, so a path with a third of all
    changes leaves every partition as one row; the folded states are written, and their number says how many buckets are needed.
    Then states go to their bucket by path and are upserted there. The merge is commutative, associative and idempotent. An
    empty feed gives an empty state.
    """
    spark = events.sparkSession
    local = written(events.mapInArrow(partial(_upsert, memory_mb=memory_mb, flush_rows=BUCKET_ROWS), STATE), "folded")
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-local.count() // BUCKET_ROWS))
    return local.repartition(n, F.xxhash64("file_path")).mapInArrow(partial(_upsert, memory_mb=memory_mb, flush_rows=None), STATE)


def current_files(state: DataFrame) -> DataFrame:
    """(file_path, content_hash) of the files that exist."""
    return state.where("alive").select("file_path", "content_hash")
