"""References to records that do not exist, by run compression of sorted parent keys and an as-of match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.paths import plain_path


def buckets_for(df: DataFrame) -> int:
    """Hash buckets for window work: a few per shuffle partition, so that no task holds much at once."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def integer_keys(keys: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Adds ``bucket`` and ``rank``: a dense integer, ascending with the key within its hash bucket.

    ``keys`` must be distinct in ``by``; hashing them spreads evenly whatever their frequency in the data.
    """
    w = Window.partitionBy("bucket").orderBy(*by)
    return keys.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")).withColumn("rank", F.row_number().over(w).cast("long"))


def runs(parents: DataFrame, part: list[str], key: str) -> DataFrame:
    """Compress integer parent keys to maximal runs of consecutive values: (part..., run_start, run_end).

    ``parents`` must be distinct. Nulls are no keys. Empty in, empty out.
    """
    w = Window.partitionBy(*part).orderBy(key)
    island = F.col(key) - F.row_number().over(w)
    return parents.where(F.col(key).isNotNull()).withColumn("_island", island).groupBy(*part, "_island").agg(F.min(key).alias("run_start"), F.max(key).alias("run_end")).drop("_island")


def beyond_runs(references: DataFrame, parent_runs: DataFrame, part: list[str], key: str) -> DataFrame:
    """As-of match: rows of ``references`` whose key lies beyond the end of the run that starts last before it."""
    cols = references.columns
    null = lambda c: F.lit(None).cast(references.schema[c].dataType).alias(c)
    events = references.select(*cols, F.lit(1).alias("_kind"), F.col(key).alias("_at"), F.lit(None).cast("long").alias("_end")).unionByName(
        parent_runs.select(*[F.col(c) if c in part else null(c) for c in cols], F.lit(0).alias("_kind"), F.col("run_start").alias("_at"), F.col("run_end").alias("_end"))
    )
    w = Window.partitionBy(*part).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.last("_end", ignorenulls=True).over(w)
    return events.withColumn("_reach", reached).where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_at") > F.col("_reach")))).select(*cols)


def integer_orphans(references: DataFrame, parents: DataFrame, key: str, width: int = 1 << 20) -> DataFrame:
    """Distinct integer keys of ``references`` without a row in ``parents``.

    Keys are cut into ranges of ``width`` values, which are the units of work; a run that crosses a
    range ends there, which changes no answer. Null keys refer to nothing. Other columns are ignored.
    """
    cell = F.floor(F.col(key) / F.lit(width)).alias("bucket")
    pick = lambda df: df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().select(key, cell)
    return beyond_runs(pick(references), runs(pick(parents), ["bucket"], key), ["bucket"], key).select(key)


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct rows of ``references`` whose (universe, missing_key) is in no row of ``parents`` (universe, missing_key).

    String keys get dense integers over the sorted union of both sides, per hash bucket; the parents'
    integers are compressed to runs and references are as-of matched against them. Key sets are made
    distinct before they are shuffled, so a key that a third of all rows use is one row here; going back to the
    referring rows is an equi-join on the orphan keys alone, which adaptive execution splits when skewed.

    A null key refers to nothing and is no parent. Empty tables give no rows. Repeated references count once.
    """
    by = ["universe", "missing_key"]
    known = F.col("missing_key").isNotNull()
    keys = (
        references.where(known).select(*by, F.lit(True).alias("is_reference"), F.lit(False).alias("is_parent"))
        .unionByName(parents.where(known).select(*by, F.lit(False).alias("is_reference"), F.lit(True).alias("is_parent")))
        .groupBy(*by).agg(F.max("is_reference").alias("is_reference"), F.max("is_parent").alias("is_parent"))
    )
    ranked = integer_keys(keys, by, buckets_for(references))
    lost = beyond_runs(ranked.where("is_reference").select(*by, "bucket", "rank"), runs(ranked.where("is_parent").select("bucket", "rank"), ["bucket"], "rank"), ["bucket"], "rank")
    return references.where(known).distinct().join(lost.select(*by), by, "left_semi")


def latest_listing(file_info: DataFrame) -> DataFrame:
    """The valid listing row per plain path: latest ``listed_at``; ties go to the greatest (modified, size, flags). Null paths are no files."""
    row = F.struct("listed_at", "modified", "size", "is_dir", "is_deleted", "name")
    return file_info.select(plain_path(F.col("path")).alias("path"), row.alias("r")).where(F.col("path").isNotNull()).groupBy("path").agg(F.max("r").alias("r")).select("path", "r.*")


def month(seconds: Column) -> Column:
    """``yyyy-MM`` in UTC of epoch seconds, whatever the session's time zone."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def vault_references(entries: DataFrame, runs_found: DataFrame, requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references between the tables of a vault, and the keys that are stored (see TESTDATA.md, P5)."""

    def ref(df: DataFrame, table: str, field: str, universe: str, ref_id: Column, key: Column, period: Column) -> DataFrame:
        return df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), ref_id.cast("string").alias("ref_id"), F.lit(universe).alias("universe"), key.alias("missing_key"), period.alias("period"))

    entry_paths = entries.select("id", "created_at", plain_path(F.col("file_path")).alias("path"))
    lost_ids = runs_found.select("run_id", "detected_at", F.explode("orphaned_entry_ids").alias("key"))
    lost_paths = runs_found.select("run_id", "detected_at", F.explode("missing_file_paths").alias("key"))
    references = (
        ref(entry_paths, "embedding_entry", "file_path", "file", F.col("id"), F.col("path"), month(F.col("created_at")))
        .unionByName(ref(lost_ids, "orphan_detection_result", "orphaned_entry_ids", "entry", F.col("run_id"), F.col("key"), month(F.col("detected_at"))))
        .unionByName(ref(lost_paths, "orphan_detection_result", "missing_file_paths", "entry_path", F.col("run_id"), plain_path(F.col("key")), month(F.col("detected_at"))))
        .unionByName(ref(requests, "search_request", "entry_id", "entry", F.col("request_id"), F.col("entry_id"), month(F.unix_timestamp("requested_at"))))
    )
    stored = latest_listing(files).where(~F.coalesce("is_deleted", F.lit(False)) & ~F.coalesce("is_dir", F.lit(False)))
    parents = (
        stored.select(F.lit("file").alias("universe"), F.col("path").alias("missing_key"))
        .unionByName(entries.select(F.lit("entry").alias("universe"), F.col("id").alias("missing_key")))
        .unionByName(entry_paths.select(F.lit("entry_path").alias("universe"), F.col("path").alias("missing_key")))
    )
    return references, parents


def vault_orphans(entries: DataFrame, runs_found: DataFrame, requests: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_id, missing_key, period) of every orphan reference."""
    return orphan_references(*vault_references(entries, runs_found, requests, files)).drop("universe")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references, distinct missing keys and referring rows per table, field and period."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(
        F.count(F.lit(1)).alias("orphan_references"), F.countDistinct("missing_key").alias("missing_keys"), F.countDistinct("ref_id").alias("referring_rows")
    )
