"""JSON batch files (a header and a list of entries), for exchange with other tools; Parquet is the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = (1, 0)

ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("file_path", T.StringType()), T.StructField("chunk_id", T.StringType()),
    T.StructField("text_hash", T.StringType()), T.StructField("text_length", T.LongType()), T.StructField("content_preview", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("custom_metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("created_at", T.LongType()), T.StructField("updated_at", T.LongType()),
])
HEADER = T.StructType([T.StructField("major", T.IntegerType()), T.StructField("minor", T.IntegerType()), T.StructField("entries", T.LongType()), T.StructField("model_name", T.StringType())])


def write_batches(entries: DataFrame, path: str, codec: str = "gzip", rows_per_file: int = 1000) -> None:
    """One JSON object per file part of at most ``rows_per_file`` entries of one model, compressed (gzip, lz4, none)."""
    if codec not in ("gzip", "lz4", "none"):
        raise ValueError("codec must be gzip, lz4 or none")
    names = [f.name for f in ENTRY.fields]
    n = max(1, -(-entries.count() // rows_per_file))
    grouped = entries.select(*names).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("model_name", "_part").agg(F.collect_list(F.struct(*names)).alias("entries"))
    header = F.struct(F.lit(VERSION[0]).alias("major"), F.lit(VERSION[1]).alias("minor"), F.size("entries").cast("long").alias("entries"), F.col("model_name"))
    grouped.select(header.alias("header"), "entries").write.mode("overwrite").option("compression", codec).json(path)


def _read(spark: SparkSession, path: str, fields: list[T.StructField]) -> DataFrame:
    rows = spark.read.schema(T.StructType(fields)).option("pathGlobFilter", "*.json*").json(path)
    # readable: same major version, minor not newer than ours
    return rows.where((F.col("header.major") == VERSION[0]) & (F.col("header.minor") <= VERSION[1]))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all batch files (compression by file name); files of another version are left out."""
    return _read(spark, path, [T.StructField("header", HEADER), T.StructField("entries", T.ArrayType(ENTRY))]).select(F.explode("entries").alias("e")).select("e.*")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers only; the parser skips the entries."""
    return _read(spark, path, [T.StructField("header", HEADER)]).select("header.*")
