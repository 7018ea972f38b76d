"""Ordered computations over groups of any size: a group's rows are cut into slices of its order, so that no task sorts a whole group.

Each slice is worked on by itself; what it must know of the slices before it comes from a table of one row per group and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group.
SLICES = 64


def in_slices(rows: DataFrame, by: list[str], at: str, slices: int | None = None) -> DataFrame:
    """Adds ``_g`` (the group, as a struct, so that null groups meet) and ``_slice``: ascending with ``at``, of about equal size by approximate
    quantiles. Rows with one ``at`` share a slice; null ``at`` comes first."""
    n = slices or SLICES
    keyed = rows.withColumn("_g", F.struct(*by))
    edges = keyed.groupBy("_g").agg(F.percentile_approx(at, F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n).alias("_edges"))
    number = F.when(F.col(at).isNull() | F.col("_edges").isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(at))))
    return keyed.join(edges, "_g").withColumn("_slice", number).drop("_edges")


def preceding(cut: DataFrame, at: list[str], item: Column, k: int) -> DataFrame:
    """Adds ``_before`` to rows of :func:`in_slices`: array of struct(v) of the up to ``k`` rows before each in its group, oldest first."""
    w = Window.partitionBy("_g", "_slice")
    rows = cut.withColumn("_item", F.struct(item.alias("v")))
    last = rows.withColumn("_n", F.row_number().over(w.orderBy(*[F.desc(c) for c in at]))).where(F.col("_n") <= k)
    tails = last.groupBy("_g", "_slice").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_item"))).alias("_tail")).select("_g", "_slice", F.transform("_tail", lambda x: x["_item"]).alias("_tail"))
    earlier = F.flatten(F.collect_list("_tail").over(Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    starts = tails.select("_g", "_slice", _last(earlier, k).alias("_earlier"))  # groups x slices rows of k items
    inside = F.collect_list("_item").over(w.orderBy(*at).rowsBetween(-k, -1))
    return rows.withColumn("_inside", inside).join(starts, ["_g", "_slice"]).withColumn("_before", _last(F.concat("_earlier", "_inside"), k)).drop("_item", "_inside", "_earlier")


def _last(items: Column, k: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), F.lit(k))


def numbered(cut: DataFrame, at: list[str]) -> DataFrame:
    """Adds ``_position`` in the group, from 1."""
    sizes = cut.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_g", "_slice", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_g", "_slice").orderBy(*at))
    return cut.withColumn("_place", place).join(starts, ["_g", "_slice"]).withColumn("_position", F.col("_start") + F.col("_place")).drop("_place", "_start")


def carried(cut: DataFrame, at: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that isn't null, of the row itself or of the rows before it in its group."""
    rows = cut.withColumn("_value", value)
    order = F.struct(*at)
    ends = rows.groupBy("_g", "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), order)).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("_g", "_slice", before.alias("_from"))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy("_g", "_slice").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(starts, ["_g", "_slice"]).withColumn(name, F.coalesce("_inside", "_from")).drop("_value", "_inside", "_from")
