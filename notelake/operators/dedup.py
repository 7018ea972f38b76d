"""Exact and similarity-based deduplication of entries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.vectors import cosine, vector_hash
from notelake.operators.references import best_references  # noqa: F401
from notelake.operators.search import block_search
from notelake.session import written


#: Open pairs that one task may settle.
FEW_PAIRS = 2_000_000


def digest(*columns: str) -> Column:
    """SHA-256 of the columns together: what is grouped and shuffled in place of whole texts."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def _keyed(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    return rows.dropna(subset=[*by, key]).select(digest(*by).alias("digest"), F.col(key).alias("key"))


def exact_groups(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(digest, original, duplicates, last): groups of rows equal in ``by`` (no nulls), with the least and greatest key and the number of further keys."""
    return _keyed(rows, by, key).groupBy("digest").agg(F.min("key").alias("original"), (F.countDistinct("key") - 1).alias("duplicates"), F.max("key").alias("last")).where("duplicates > 0")


def exact_mapping(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(member, representative): each duplicate with its original. A hot group is one minimum, then an equi-join, never a collected list."""
    known = _keyed(rows, by, key).distinct()
    firsts = known.groupBy("digest").agg(F.min("key").alias("representative"))
    return known.join(firsts, "digest").where("key <> representative").select(F.col("key").alias("member"), "representative")


def without(rows: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Survivors: all rows that the mapping doesn't replace."""
    return rows.join(mapping.select(F.col("member").alias(key)).distinct(), key, "left_anti")


def close_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of entries (id, vector) with cosine at or above the threshold; exact, by blocks."""
    hits = block_search(entries, entries, None, threshold)
    return hits.where(F.col("query") < F.col("id")).select(F.col("query").alias("a"), F.col("id").alias("b"), "similarity")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy order itself over pairs (a, b) that come sorted by a: who is taken by an earlier one that is not taken itself."""
    taken: set[str] = set()
    for batch in batches:
        fresh = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if a not in taken and b not in taken:
                taken.add(b)
                fresh.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.string())], ["id"])


def taken_ids(pairs: DataFrame) -> DataFrame:
    """(id) of the entries that an earlier one takes, by pairs (a, b), a < b: the entries that are left take all their later ones, in id order.

    Rounds while the pairs are many: an entry without an earlier open one takes its later ones; pairs with a taken entry are
    settled. Once no more than FEW_PAIRS are open, one task goes through them in order. Ids that say nothing about
    similarity (hashes) settle in about the logarithm of their number of rounds; however many it takes, all are settled.
    """
    open_, found = pairs.select("a", "b"), []
    while (n := open_.count()) > FEW_PAIRS:
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = written(open_.join(first, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "taken")
        found.append(now)
        open_ = written(open_.join(now.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti"), "open")
    if n:
        found.append(open_.repartition(1).sortWithinPartitions("a", "b").mapInArrow(_in_order, "id string"))
    if not found:
        return pairs.select(F.col("b").alias("id")).limit(0)
    return written(reduce(DataFrame.unionByName, found), "taken")


def greedy_clusters(entries: DataFrame, threshold: float) -> DataFrame:
    """(seed, member, similarity): clusters in the greedy way, seeds taken in id order, each taking all free entries at or above the threshold.

    Not transitive. Exact copies of a vector are taken together, so a hot group of copies makes no pairs. The pair list is the exact
    similarity join; :func:`taken_ids` settles it, and each member goes to its first close entry that is not taken.
    """
    usable = entries.select(F.col("id").cast("string").alias("id"), "vector").where("id is not null").withColumn("h", vector_hash(F.col("vector")))
    copies = written(usable.select("h", "id"), "copies")
    firsts = copies.groupBy("h").agg(F.min("id").alias("first"))
    distinct = written(usable.join(firsts, "h").where("id = first").select("id", "vector").dropDuplicates(["id"]), "distinct")
    pairs = written(close_pairs(distinct, threshold), "pairs")
    taken = taken_ids(pairs)
    found = pairs.join(taken.withColumnRenamed("id", "a"), "a", "left_anti").groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("m")).select(F.col("m.a").alias("seed"), F.col("b").alias("member"), F.col("m.similarity").alias("similarity"))
    # a copy goes where the first one of its vector goes, or to that one if it is a seed
    twins = copies.join(firsts, "h").where("id <> first").select(F.col("first").alias("member"), "id").distinct()
    if threshold > 1 or not twins.limit(1).count():
        return found
    same = twins.join(distinct.select(F.col("id").alias("member"), "vector").where(cosine(F.col("vector"), F.col("vector")).isNotNull()).select("member"), "member")
    moved = same.join(found, "member", "left").select(F.coalesce("seed", "member").alias("seed"), F.col("id").alias("member"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return found.unionByName(moved)


def representatives(clusters: DataFrame, rows: DataFrame, strategy: str = "most_recent") -> DataFrame:
    """(seed, representative) per cluster: most_recent, earliest or longest_content; ties by the least id.

    ``rows``: (id, created_at, updated_at, text_length).
    """
    value = {"most_recent": F.col("updated_at"), "earliest": -F.col("created_at"), "longest_content": F.col("text_length")}[strategy]
    members = clusters.select("seed", F.col("member").alias("id")).unionByName(clusters.select("seed", F.col("seed").alias("id")).distinct())
    scored = members.join(rows.select(F.col("id").cast("string").alias("id"), value.cast("double").alias("value")), "id")
    top = scored.groupBy("seed").agg(F.max("value").alias("value"))
    return scored.join(top, "seed").where(scored["value"].eqNullSafe(top["value"])).groupBy("seed").agg(F.min("id").alias("representative"))


def central_representatives(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, representative): the member with the highest mean similarity to the others that are close to it; ties by the least id."""
    members = clusters.select("seed", F.col("member").alias("id")).unionByName(clusters.select("seed", F.col("seed").alias("id")).distinct())
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    inside = both.join(members, "id").join(members.select(F.col("seed").alias("seed2"), F.col("id").alias("other")), "other").where("seed = seed2")
    mean = inside.groupBy("seed", "id").agg(F.round(F.avg("similarity"), 9).alias("mean"))
    w = Window.partitionBy("seed").orderBy(F.desc("mean"), "id")
    return mean.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("seed", F.col("id").alias("representative"))


def reference_mapping(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """(member, representative) of every cluster member but the representative itself."""
    members = clusters.select("seed", F.col("member").alias("member")).unionByName(clusters.select("seed", F.col("seed").alias("member")).distinct())
    return members.join(chosen, "seed").where("member <> representative").select("member", "representative")


def resolve(ids: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Each id with its representative, or itself."""
    return ids.join(mapping.withColumnRenamed("member", key), key, "left").withColumn("resolved", F.coalesce("representative", key)).drop("representative")


def merged_counts(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("representative").agg(F.count(F.lit(1)).alias("merged"))


def statistics(total: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows before, rows replaced, rows kept, percent reduction."""
    a, b = total.agg(F.count(F.lit(1)).alias("rows")), mapping.agg(F.countDistinct("member").alias("replaced"))
    return a.join(b, how="cross").withColumn("kept", F.col("rows") - F.col("replaced")).withColumn("reduction_percent", F.when(F.col("rows") > 0, F.col("replaced") * 100.0 / F.col("rows")).otherwise(F.lit(0.0)))  # one row each


def broken_references(rows: DataFrame, survivors: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Integrity check: ids that are neither kept nor mapped, and mappings to ids that are not kept. Empty if all is well."""
    kept = survivors.select(F.col(key).cast("string").alias("k")).distinct()
    lost = rows.select(F.col(key).cast("string").alias("k")).distinct().join(kept, "k", "left_anti").join(mapping.select(F.col("member").alias("k")), "k", "left_anti")
    dangling = mapping.select(F.col("representative").alias("k")).distinct().join(kept, "k", "left_anti")
    return lost.withColumn("problem", F.lit("lost")).unionByName(dangling.withColumn("problem", F.lit("dangling")))


def duplication_analysis(entries: DataFrame, threshold: float) -> DataFrame:
    """Close pairs, distinct entries in them, their share, mean similarity and a suggested threshold (.98, .95 or .90, as the mean is above .9, above .7 or lower)."""
    pairs = close_pairs(entries, threshold)
    total = entries.agg(F.count(F.lit(1)).alias("entries"))
    found = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.countDistinct("id").alias("members"))
    rate = F.when(F.col("entries") > 0, F.col("members") / F.col("entries")).otherwise(F.lit(0.0))
    joined = total.join(found, how="cross").join(members, how="cross").withColumn("rate", F.round(rate, 6))  # one row each
    return joined.withColumn("suggested_threshold", F.when(F.col("mean_similarity") > 0.9, 0.98).when(F.col("mean_similarity") > 0.7, 0.95).otherwise(0.90))
