"""Positions within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_tokens(text: Column) -> Column:
    """Tokens of the byte-level tokenizer, one per UTF-8 byte; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def salted_rank(df: DataFrame, group: list[str], order: Column, ties: list[str], salts: int | None = None) -> DataFrame:
    """Adds ``rank``: 0-based position of the row in its group by (``order``, ``ties``).

    ``order`` is a long that spreads evenly (a hash). Its range is cut into ``salts`` slices; rows are numbered
    within (group, slice), and each slice starts where the counts of the slices before it end. So a group with a
    third of all rows is spread over all slices. The counts table has at most groups x salts rows.
    """
    n = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = F.least(F.lit(n - 1), F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * n)).cast("int")
    sliced = df.withColumn("_order", order).withColumn("_salt", cut)
    counts = sliced.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = sliced.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy("_order", *ties)))
    return numbered.join(starts, [*group, "_salt"]).withColumn("rank", F.col("_start") + F.col("_row") - 1).drop("_order", "_salt", "_row", "_start")
