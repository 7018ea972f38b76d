"""Differences between versions of a text, and the gates that decide whether a change matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_sections(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, first_line, last_line, lines): runs of lines, by position from 0, in which the versions differ. Null is an empty text.

    Lines are compared inside the row; only differing ones become rows, and runs are found per key.
    """
    a, b = F.split(F.coalesce(old, F.lit("")), "\n"), F.split(F.coalesce(new, F.lit("")), "\n")
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    rows = versions.select(key, F.posexplode(pairs).alias("line", "same")).where(~F.col("same"))
    island = F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("_i", island).groupBy(key, "_i").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("lines")).drop("_i")


def is_significant(old: Column, new: Column, least: int = 5) -> Column:
    """The texts differ and so do their lengths, by at least 5 characters."""
    return F.coalesce((F.abs(F.length(new) - F.length(old)) >= least) & (new != old), F.lit(False))


def suggestion_gate(edits: DataFrame, key: str, at: str, paragraph: str, least: int = 20, quiet_ms: int = 500) -> DataFrame:
    """Edits that may ask for suggestions: a paragraph of at least 20 characters, no further edit within half a second, another text than the last one asked about."""
    w = Window.partitionBy(key).orderBy(at)
    ms = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
    nxt = F.lead(at).over(w)
    quiet = edits.withColumn("_quiet", nxt.isNull() | (ms(nxt) - ms(F.col(at)) > quiet_ms)).where(F.col("_quiet") & (F.length(paragraph) >= least)).drop("_quiet")
    return quiet.withColumn("_last", F.lag(paragraph).over(w)).where(~F.col("_last").eqNullSafe(F.col(paragraph))).drop("_last")


def is_suggestion(title: Column, path: Column, content: Column) -> Column:
    """Has a title, a path or content."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(path, F.lit("")), F.nullif(content, F.lit(""))).isNotNull()
