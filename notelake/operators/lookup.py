"""Live view, key lookups, filters, validation and derived rows of embedding entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.paths import extension
from notelake.functions.vectors import is_finite, is_zero


def live(entries: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Latest version per key; null keys are dropped. Ties are settled by the remaining columns that can be ordered, so the result is one whatever the input order."""
    rest = [f.name for f in entries.schema.fields if f.name not in (key, *order) and f.dataType.typeName() not in ("map", "variant")]
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
    return entries.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def get(rows: DataFrame, *ids: str, key: str = "id") -> DataFrame:
    """Rows of the given ids; unknown ones are left out."""
    return rows.where(F.col(key).isin(*ids))


def get_many(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in a table of keys; repeated keys count once."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def exists(rows: DataFrame, value: str, key: str = "id") -> bool:
    return bool(rows.where(F.col(key) == value).limit(1).count())


def by_hash(rows: DataFrame) -> DataFrame:
    """Latest id per content hash (ties: the greatest id)."""
    return rows.where("text_hash is not null").groupBy("text_hash").agg(F.max(F.struct("updated_at", "id")).alias("m")).select("text_hash", F.col("m.id").alias("id"))


def between(rows: DataFrame, low: int, high: int, at: str = "created_at") -> DataFrame:
    """Inclusive time range in epoch seconds."""
    return rows.where(F.col(at).between(low, high))


def metadata(rows: DataFrame) -> DataFrame:
    """Rows without the vector, with its dimension."""
    return rows.withColumn("dimension", F.when(F.col("vector").isNotNull(), F.size("vector"))).drop("vector")


def problems() -> Column:
    """Names of the rules that a row breaks (empty: valid)."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    rules = {
        "id": blank("id"), "file_path": blank("file_path"), "chunk_id": blank("chunk_id"), "model_name": blank("model_name"),
        "text_hash": F.coalesce(F.length("text_hash"), F.lit(0)) != 64, "text_length": F.coalesce(F.col("text_length"), F.lit(0)) <= 0,
        "vector_empty": F.coalesce(F.size("vector"), F.lit(0)) <= 0, "vector_not_finite": ~F.coalesce(is_finite(F.col("vector")), F.lit(True)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with the rules they break)."""
    marked = rows.withColumn("problems", problems())
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def corrupt(rows: DataFrame) -> DataFrame:
    """Rows with an empty or all-zero vector or blank metadata."""
    return rows.where(F.col("vector").isNull() | is_zero(F.col("vector")) | F.coalesce(F.trim("file_path") == "", F.lit(True)) | F.coalesce(F.trim("model_name") == "", F.lit(True)))


def preview(text: Column, most: int = 100) -> Column:
    """The text, or its first ``most - 3`` characters and three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def entry_id(path: Column, chunk: Column, text_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, chunk, text_hash), 256)


def entries_from_text(rows: DataFrame, model: str, at: int, path: str = "file_path", chunk: str = "chunk_id", text: str = "content") -> DataFrame:
    """Entry rows (without vector) of chunk texts: hashes, preview, byte length, deterministic id. Null texts are left out."""
    t, h = F.col(text), F.sha2(F.col(text), 256)
    return rows.where(t.isNotNull()).select(
        entry_id(F.col(path), F.col(chunk), h).alias("id"), F.col(path).alias("file_path"), F.col(chunk).alias("chunk_id"), h.alias("text_hash"), F.octet_length(t).cast("long").alias("text_length"),
        preview(t).alias("content_preview"), F.lit(model).alias("model_name"), F.lit(at).cast("long").alias("created_at"), F.lit(at).cast("long").alias("updated_at"),
    )


def footprint() -> Column:
    """Estimated bytes of a row: 4 per dimension, its strings, its map, 40 fixed."""
    text = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    pairs = F.aggregate(F.map_entries("custom_metadata"), F.lit(0), lambda acc, e: acc + text(e["key"]) + text(e["value"]))
    strings = sum((text(c) for c in ("id", "file_path", "chunk_id", "content_preview", "model_name", "text_hash")), F.lit(0))
    return (F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) * 4 + strings + F.coalesce(pairs, F.lit(0)) + 40).cast("long")


def row_checksum() -> Column:
    """SHA-256 of the row as JSON."""
    return F.sha2(F.to_json(F.struct("*")), 256)


def index_statistics(rows: DataFrame) -> DataFrame:
    """Entries, distinct paths, models, hashes and hour buckets."""
    return rows.agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("file_path").alias("paths"), F.countDistinct("model_name").alias("models"),
        F.countDistinct("text_hash").alias("hashes"), F.countDistinct(F.floor(F.col("created_at") / 3600)).alias("hour_buckets"),
    )


def is_note(path: Column) -> Column:
    return F.coalesce(extension(path).isin("md", "txt", "markdown"), F.lit(False))


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page in a total order, with ``has_more``. One row beyond the page is read to know it."""
    if number < 0 or size < 1:
        raise ValueError("page number must not be negative, size at least 1")
    taken = rows.orderBy(*order).offset(number * size).limit(size + 1)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return taken.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(0))) > size).where(F.col("_n") <= size).drop("_n")
