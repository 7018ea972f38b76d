"""Similarity search: exact top-k, threshold and batch search, sampling search, and the post-filters."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.vectors import cosine, unit_rows
from notelake.operators.cells import STEP, Layout, cells_for, centers_of, homes, matrix, may_reach, model_counts, nearest_center, sampled
from notelake.session import written

#: Rows of the collection in one block of a batch search, and from which on blocks are of near cells.
BLOCK_ROWS, CELLS_FROM = 32_768, 65_536
FLOAT_SLACK = 1e-5

HITS = "query string, id string, similarity double"
UNITS = "model_name string, id string, key long, vector array<double>, unit binary"


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of a search. ``pre_filter`` drops context files before top-k is taken, otherwise after it."""

    k: int = 10
    min_threshold: float = 0.3
    max_results: int = 10
    diversity_threshold: float | None = 0.95
    recency_weight: float = 0.1
    exclude_files: tuple[str, ...] = ()
    pre_filter: bool = False

    def check(self) -> SearchConfig:
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if not -1 <= self.min_threshold <= 1:
            raise ValueError("min_threshold must lie in [-1, 1]")
        if self.max_results < 0:
            raise ValueError("max_results must not be negative")
        if self.recency_weight < 0:
            raise ValueError("recency_weight must not be negative")
        return self

    @property
    def keep(self) -> int:
        return min(self.k, self.max_results) if self.max_results else self.k


#: The two presets: of the library, and of the engine in front of it.
LIBRARY = SearchConfig()
ENGINE = SearchConfig(min_threshold=0.1, diversity_threshold=None, recency_weight=0.0)


def check_engine(min_similarity: float, max_results: int, timeout_ms: int = 5000) -> None:
    """The engine's limits: similarity 0..1, results 1..50, time 100..30000 ms."""
    if not 0 <= min_similarity <= 1 or not 1 <= max_results <= 50 or not 100 <= timeout_ms <= 30_000:
        raise ValueError("min_similarity must be in 0..1, max_results in 1..50, timeout_ms in 100..30000")


def checked_query(vector: list[float]) -> list[float]:
    if not vector or not all(math.isfinite(x) for x in vector) or not any(vector):
        raise ValueError("a query vector must be finite, not empty and not zero")
    return [float(x) for x in vector]


def scored(entries: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Adds ``similarity`` to the query; rows whose vector cannot be compared are dropped."""
    q = F.array(*[F.lit(x) for x in checked_query(query)])
    size = math.sqrt(sum(x * x for x in query))
    return entries.withColumn("similarity", cosine(F.col(vector), q, norm_b=F.lit(size))).where(F.col("similarity").isNotNull())


def with_rank(hits: DataFrame, *by: Column | str, per: list[str] | None = None) -> DataFrame:
    """1-based ``rank`` in the given order; for bounded result sets, or per group."""
    w = Window.partitionBy(*(per or [F.lit(0)])).orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(w))


def top_k(entries: DataFrame, query: list[float], config: SearchConfig = ENGINE, id_col: str = "id", vector: str = "vector", path: str | None = None) -> DataFrame:
    """The ``keep`` most similar rows at or above the threshold, ties by id, with ``similarity``.

    Bad rows are dropped, an empty table gives no rows. The plan is one pass with a bounded heap per partition
    (TakeOrderedAndProject); nothing is shuffled but the heaps.
    """
    config.check()
    rows = entries
    if path and config.exclude_files and config.pre_filter:
        rows = rows.where(F.col(path).isNull() | ~F.col(path).isin(*config.exclude_files))
    hits = scored(rows, query, vector).where(F.col("similarity") >= config.min_threshold).orderBy(F.desc("similarity"), id_col).limit(config.keep)
    if path and config.exclude_files and not config.pre_filter:
        hits = exclude_context(hits, config.exclude_files, path)
    return hits


def exclude_context(hits: DataFrame, files: tuple[str, ...], path: str = "file_path") -> DataFrame:
    """Drops hits in the given files; hits without a path stay."""
    return hits.where(F.col(path).isNull() | ~F.col(path).isin(*files)) if files else hits


def exclude_context_rows(hits: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """The same with the files in a table."""
    return hits.join(files.select(path).distinct(), path, "left_anti")


def recency_weighted(hits: DataFrame, weight: float, updated: str = "updated_at", per: list[str] | None = None) -> DataFrame:
    """similarity + weight x (1 - age / age range of the hits), at most 1; unchanged where all are of one age. Null times get no boost."""
    w = Window.partitionBy(*(per or [F.lit(0)]))
    newest, oldest = F.max(updated).over(w), F.min(updated).over(w)
    boost = F.coalesce(weight * (1 - (newest - F.col(updated)) / (newest - oldest)), F.lit(0.0))
    return hits.withColumn("similarity", F.when(newest > oldest, F.least(F.lit(1.0), F.col("similarity") + boost)).otherwise(F.col("similarity")))


def age_reranked(hits: DataFrame, now: int, created: str = "created_at", id_col: str = "id", per: list[str] | None = None) -> DataFrame:
    """Rank by similarity x (1 + 0.1 x min(age in days, 30)), descending; ties by id. Times in the future count as new."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.col(created)) / F.lit(86400.0))
    rows = hits.withColumn("age_score", F.col("similarity") * (1 + 0.1 * F.least(days, F.lit(30.0))))
    return with_rank(rows, F.desc("age_score"), id_col, per=per)


def _diverse(pdf: pd.DataFrame, threshold: float, most: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["similarity", "id"], ascending=[False, True], kind="stable")
    kept: list[tuple[int, np.ndarray, float]] = []
    for i, v in enumerate(pdf["vector"]):
        v = np.asarray(v, np.float64)
        size = float(np.sqrt(v @ v))
        near = any(len(u) == len(v) and size * n > 0 and float(v @ u) / (size * n) >= threshold for _, u, n in kept)
        if not near:
            kept.append((i, v, size))
        if most and len(kept) >= most:
            break
    out = pdf.iloc[[i for i, _, _ in kept]].copy()
    out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
    return out.drop(columns=["vector"])


def diverse(hits: DataFrame, threshold: float, max_results: int = 0, query: str = "query") -> DataFrame:
    """Greedy in rank order: a hit stays if its cosine to every kept one is below the threshold (vectors of other lengths don't count).

    ``hits``: (query, id, similarity, vector); a group is one query's top-k, so it is small by construction.
    """
    schema = hits.drop("vector").withColumn("rank", F.lit(1)).schema
    return hits.groupBy(query).applyInPandas(partial(_diverse, threshold=threshold, most=max_results), schema)


def _columns(b: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
    values = b.column("vector")
    width = int(values.value_lengths()[0].as_py())
    return b.column("id").to_pylist(), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, width), b.column("low").to_numpy(zero_copy_only=False)


def _search(batches: Iterator[pa.RecordBatch], k: int | None, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows by (block, kind): first the block's rows, then queries stream through, each with the least similarity that it asks for. Single precision finds candidates, double decides."""
    at, ids, parts, rows, unit, small = None, [], [], None, None, None

    def units(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    for batch in batches:
        key = batch.column("block").to_numpy(zero_copy_only=False) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            if a == z:
                continue
            mine, x, least = _columns(batch.slice(a, z - a))
            if key[a] // 2 != at:
                at, ids, parts, rows = key[a] // 2, [], [], None
            if key[a] % 2 == 0:
                ids += mine
                parts.append(units(x))
                continue
            if not parts:
                continue
            if rows is None:
                unit = np.concatenate(parts)
                rows, small = np.array(ids, object), unit.astype(np.float32)
            q = units(x)
            for s in range(0, len(q), 256):
                part = q[s : s + 256]
                score = part.astype(np.float32) @ small.T
                low = (least[s : s + 256] - FLOAT_SLACK).astype(np.float32)
                if k is not None and len(rows) > k:
                    low = np.maximum(low, np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] - FLOAT_SLACK)
                i, j = np.nonzero(score >= low[:, None])
                for c in range(0, len(i), 200_000):
                    exact = np.clip(np.einsum("ij,ij->i", part[i[c : c + 200_000]], unit[j[c : c + 200_000]]), -1.0, 1.0)
                    keep = np.flatnonzero(exact >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array([mine[s + n] for n in i[c + keep]], pa.string()), pa.array(rows[j[c + keep]], pa.string()), pa.array(exact[keep])], ["query", "id", "similarity"])


def _good(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), "vector").where(F.col("id").isNotNull() & (F.size("vector") > 0)).where(cosine(F.col("vector"), F.col("vector")).isNotNull())


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scanned(index: DataFrame, asked: DataFrame, blocks: int, k: int | None, threshold: float) -> DataFrame:
    """Hits of (block, id, vector) against (block, id, vector, low): one task holds one block, and the queries stream through it."""
    both = index.select("block", F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("low")).unionByName(asked.select("block", F.lit(1).alias("kind"), "id", "vector", "low"))
    placed = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    return placed.mapInArrow(partial(_search, k=k, threshold=threshold), HITS)


def block_search(queries: DataFrame, entries: DataFrame, k: int | None, threshold: float = -1.0) -> DataFrame:
    """(query, id, similarity): for each query its ``k`` most similar entries (all, if k is None) at or above the threshold, exactly.

    Both sides are (id string, vector array) with vectors of one length; unusable vectors are dropped on both. The entries are cut
    into blocks, one task holds one block, and queries stream through it as matrix products: nothing is broadcast, no group is
    gathered. Up to CELLS_FROM entries, blocks are by a hash of the id and every query goes to each of them. Beyond that, blocks are of near cells, and a
    query goes to those only that may hold what it asks for (:func:`cell_search`).
    """
    spark = entries.sparkSession
    n = entries.count()
    if n > CELLS_FROM:
        return cell_search(queries, entries, k, threshold)
    blocks = max(1, -(-n // BLOCK_ROWS), min(-(-n // 1024), spark.sparkContext.defaultParallelism))
    index = _good(entries).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = _good(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vector", F.lit(float(threshold)).alias("low"))
    hits = _scanned(index, asked, blocks, k, threshold)
    return hits if k is None else _best(hits, k)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            _, x = unit_rows(b.column("vector"), len(b.column("vector")[0]))
            yield pa.RecordBatch.from_arrays([pa.array([""] * b.num_rows), b.column("id"), b.column("key"), b.column("vector"), pa.array([r.tobytes() for r in x], pa.binary())], ["model_name", "id", "key", "vector", "unit"])


def _to_blocks(batches: Iterator[pa.RecordBatch], layout: Layout, visits: bool) -> Iterator[pa.RecordBatch]:
    """Rows to the block of their cell, or (``visits``) to all blocks whose cells may hold what is as similar as they ask for."""
    width = layout.units.shape[1]
    for b in batches:
        keys, lows = b.column("key").to_numpy(), b.column("low").to_numpy()
        for s in range(0, b.num_rows, STEP):
            x = matrix(b.column("unit").slice(s, STEP), np.float32, width)
            cell = nearest_center(x, layout.units)
            if visits:
                near = may_reach(x, layout.units[cell], layout.units, layout.least, lows[s : s + STEP])
                who, block = np.nonzero(near.astype(np.float32) @ layout.reaches.astype(np.float32) > 0)
            else:
                who, block = np.arange(len(x)), layout.home(cell, keys[s : s + STEP])
            at = pa.array(s + who)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *[b.column(c).take(at) for c in ("id", "vector", "low")]], ["block", "id", "vector", "low"])


def cell_search(queries: DataFrame, entries: DataFrame, k: int | None, threshold: float = -1.0) -> DataFrame:
    """:func:`block_search` by cells: exact, for tables of any size.

    Entries lie in cells around centers fitted on a bounded sample, cells in blocks of equal size. A query for all hits goes to the blocks that may hold any by
    the bounds of :func:`may_reach`. A query for ``k`` first searches the block of its own cell; its k-th best there is what others must reach, so then it goes
    to those only that may. Where vectors lie in clusters that is a few blocks, where they spread over all directions it is most.
    """
    spark = entries.sparkSession
    packed = lambda df: written(_good(df).select("id", F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("id").alias("key")).mapInArrow(_units, UNITS), "units")
    index = packed(entries)
    counts = model_counts(index)
    if not counts:
        return spark.createDataFrame([], HITS if k is None else HITS + ", rank int")
    sample = sampled(index, counts, 29)
    units = {m: centers_of(x, cells_for(counts[m])) for m, x in sample.items()}
    sizes, least = homes(index, units)
    (model, centers), = units.items()
    layout = Layout(centers, sizes[model], least[model], BLOCK_ROWS, spark.sparkContext.defaultParallelism, 1024)
    asked = index if queries is entries else packed(queries)
    place = lambda df, visits: df.mapInArrow(partial(_to_blocks, layout=layout, visits=visits), "block int, id string, vector array<double>, low double")
    least_wanted = F.lit(float(threshold)).alias("low")
    held = place(index.select("*", least_wanted), False)
    if k is None:
        return _scanned(held, place(asked.select("*", least_wanted), True), layout.blocks, None, threshold)
    near = _best(_scanned(held, place(asked.select("*", least_wanted), False), layout.blocks, k, threshold), k)
    reached = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("low")).where(F.col("n") >= k).select(F.col("query").alias("id"), "low")
    limited = asked.join(reached, "id", "left").withColumn("low", F.coalesce("low", F.lit(float(threshold))))
    return _best(_scanned(held, place(limited, True), layout.blocks, k, threshold), k)


def approximate_top_k(entries: DataFrame, query: list[float], config: SearchConfig, sample_key: Column, seed: int = 0, id_col: str = "id", vector: str = "vector", small: int = 1000) -> DataFrame:
    """Top-k of a seeded sample of max(min(10 sqrt n, n), 10 k) rows; exact below ``small`` rows, or if the sample gives fewer than k hits.

    The sample is the rows with the smallest pseudo-random key (from the long ``sample_key``), so it is the same on every run.
    """
    config.check()
    n = entries.count()
    if n < small:
        return top_k(entries, query, config, id_col, vector)
    size = max(min(int(10 * math.sqrt(n)), n), 10 * config.k)
    drawn = entries.orderBy(F.pmod((sample_key + F.lit(seed)) * F.lit(7919), F.lit(104729)), id_col).limit(size)
    hits = top_k(drawn, query, config, id_col, vector)
    return hits if hits.count() >= config.keep else top_k(entries, query, config, id_col, vector)


def search_metrics(hits: DataFrame, kind: str, searched: int, milliseconds: float, target_ms: float = 50.0) -> DataFrame:
    """One metrics row of a search that has run: kind, vectors searched, results, best and mean score, duration, vectors a second, whether the target was met."""
    rate = searched / (milliseconds / 1000) if milliseconds > 0 else 0.0
    return hits.agg(F.count(F.lit(1)).alias("results"), F.max("similarity").alias("top_score"), F.avg("similarity").alias("mean_score")).select(
        F.lit(kind).alias("operation_type"), F.lit(searched).cast("long").alias("searched"), "results", "top_score", "mean_score",
        F.lit(float(milliseconds)).alias("duration_ms"), F.lit(rate).alias("vectors_per_second"), F.lit(milliseconds <= target_ms).alias("target_met"))


def monitored_top_k(entries: DataFrame, query: list[float], config: SearchConfig = ENGINE, target_ms: float = 50.0, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(ranked hits, metrics row) of :func:`top_k`, which is run here. The hits are at most ``config.keep`` rows."""
    began = time.perf_counter()
    hits = with_rank(top_k(entries, query, config, **columns), F.desc("similarity"), columns.get("id_col", "id"))
    rows = hits.collect()
    took = (time.perf_counter() - began) * 1000
    held = entries.sparkSession.createDataFrame(rows, hits.schema)
    return held, search_metrics(held, "knn", entries.count(), took, target_ms)


def summary(hits: DataFrame, searched: int, query: str = "query") -> DataFrame:
    """Per query: results, best and mean score, efficiency (results per searched vector)."""
    return hits.groupBy(query).agg(F.count(F.lit(1)).alias("results"), F.max("similarity").alias("top_score"), F.avg("similarity").alias("mean_score"), (F.count(F.lit(1)) / F.lit(max(1, searched))).alias("efficiency"))
