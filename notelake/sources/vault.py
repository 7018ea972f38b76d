"""Files of a vault: listing, reading, change detection between listings."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.paths import depth, file_name, parent_path
from notelake.functions.text import natural_key

MAX_NOTE_BYTES = 10 * 1024 * 1024


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def _relative(path: str | Column, root: str) -> Column:
    return F.substring_index(path, root.rstrip("/") + "/", -1)


def _empty_files(files: DataFrame, root: str) -> DataFrame:
    """Paths of empty files, which a scan passes over; the listing that the driver holds for the scan has them."""
    listed = files.sparkSession.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")
    return listed.select(_relative("path", root).alias("path")).join(files.select(_relative("path", root).alias("path")), "path", "left_anti")


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, name, modified, size, is_dir) of all files below the root that match, and of the folders that hold them; the root itself is left out.

    Paths are relative to the root. Only file metadata is read, never content. Empty files have size 0 and no time.
    """
    files = _files(spark, root, pattern)
    notes = files.select(_relative("path", root).alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"))
    notes = notes.unionByName(_empty_files(files, root).select("path", F.lit(None).cast("long").alias("modified"), F.lit(0).cast("long").alias("size")))
    own = notes.select("path", file_name(F.col("path")).alias("name"), "modified", "size", F.lit(False).alias("is_dir"))
    return own.unionByName(folders(notes).select("path", file_name(F.col("path")).alias("name"), F.lit(None).cast("long").alias("modified"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir")))


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """Every folder above a file, once."""
    parts = F.split(parent_path(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(above).alias("path")).where("path <> ''").distinct()


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of the notes up to 10 MB, as UTF-8; empty notes have an empty text."""
    files = _files(spark, root, pattern)
    rows = files.where(F.col("length") <= MAX_NOTE_BYTES).select(_relative("path", root).alias("path"), F.decode("content", "UTF-8").alias("text"))
    return rows.unionByName(_empty_files(files, root).select("path", F.lit("").alias("text")))


def sorted_listing(files: DataFrame, by: str = "name") -> DataFrame:
    """Folders first, then by name without regard to case, by natural name, by time (newest first) or by size (largest first); ties by path."""
    key = {"name": F.lower("name"), "natural": natural_key(F.col("name")), "modified": F.desc("modified"), "size": F.desc("size")}[by]
    return files.orderBy(F.desc("is_dir"), key, "path")


def tree(files: DataFrame) -> DataFrame:
    """Each file with its parent folder, depth and place among its siblings (folders first, natural order)."""
    rows = files.withColumn("parent", parent_path(F.col("path"))).withColumn("depth", depth(F.col("path")))
    w = Window.partitionBy("parent").orderBy(F.desc("is_dir"), natural_key(F.col("name")), "path")
    return rows.withColumn("place", F.row_number().over(w))


def statistics(files: DataFrame) -> DataFrame:
    """Notes, folders, bytes."""
    return files.agg(F.count_if(~F.col("is_dir") & F.lower("path").endswith(".md")).alias("notes"), F.count_if("is_dir").alias("folders"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("bytes"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change_type) between two listings (path, modified, size): created, deleted, modified. This is how deletes are found, which no file stream reports."""
    a = before.where("path is not null").select("path", F.struct("modified", "size").alias("a"))
    b = after.where("path is not null").select("path", F.struct("modified", "size").alias("b"))
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type")).where("change_type is not null")
