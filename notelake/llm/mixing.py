"""Mixing sources to target weights: repeats, then subset-sum fitting of the remaining budget by length counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.ranks import salted_rank, text_tokens
from notelake.session import written

#: The part of a budget that the knapsack fits exactly: at least so many tokens and so many times the longest document, and at most the last.
LEAST_WINDOW, WINDOW_DOCUMENTS, MOST_WINDOW = 65_536, 16, 1 << 24

PLAN = "mix_id int, source string, weight double, max_repeats int, target_tokens double, source_tokens long, tokens long, documents long, repeats int, extra long, reached_tokens long, cannot_reach boolean"


def plain_source(source: Column) -> Column:
    """Lower case, no surrounding spaces, ``_`` for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), "[ -]", "_")


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most ``counts``, so that the sum is the greatest one within ``budget``.

    Bounded-knapsack dynamic programming over reachable sums; counts are split into powers of two. It stops as soon
    as the budget itself is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for j in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[j]), int(counts[j])
        if length <= 0 or length > budget:
            continue
        n, k = min(n, budget // length), 1
        while n > 0 and not reach[budget]:
            k = min(k, n)
            size = length * k
            if size <= budget:
                new = np.flatnonzero(reach[: budget + 1 - size] & ~reach[size:]) + size
                reach[new] = True
                by[new] = len(parts)
                parts.append((j, k))
            n -= k
            k *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        j, k = parts[by[at]]
        take[j] += k
        at -= int(lengths[j]) * k
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come near to ``budget`` from below.

    The last stretch of the budget, sixteen of the longest documents that fit it (all of the budget, if it isn't longer), is left to the
    knapsack, which fits it exactly. What comes before is filled with the same share of every length, rounded down, then with
    documents of lengths in seeded order, as many as are there and still fit. Documents of more than MOST_WINDOW tokens
    are beyond the knapsack: they are only taken before it.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    longest = int(lengths[(lengths <= budget) & (counts > 0)].max(initial=0))
    window = min(budget, max(LEAST_WINDOW, WINDOW_DOCUMENTS * longest), MOST_WINDOW)
    take = np.minimum(counts, np.floor(counts * ((budget - window) / total)).astype(np.int64))
    take[lengths <= 0] = 0
    left = budget - int((take * lengths).sum())
    for j in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= window:
            break
        if lengths[j] > 0:
            more = min(int(counts[j] - take[j]), left // int(lengths[j]), -(-(left - window) // int(lengths[j])))
            take[j] += more
            left -= more * int(lengths[j])
    return take + subset_sum(lengths, counts - take, min(left, window))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One (mix, source): its length histogram, null where the source has no document."""
    pdf = pdf.sort_values("tokens", na_position="last")
    r = pdf.iloc[0]
    there = pdf["tokens"].notna()
    lengths, counts = pdf.loc[there, "tokens"].to_numpy(np.int64), pdf.loc[there, "documents"].to_numpy(np.int64)
    has, target, most = int((lengths * counts).sum()), float(r.target_tokens), int(r.max_repeats)
    cannot = most * has < target
    repeats = most if cannot or has == 0 else min(most, int(target // has))
    left = 0 if cannot or repeats == most else int(target) - repeats * has
    extra = fit_budget(lengths, counts, left, int(r.mix_id))
    out = pdf.loc[there, ["mix_id", "source", "weight", "max_repeats", "target_tokens", "source_tokens", "tokens", "documents"]].copy() if there.any() else pdf.iloc[:1].copy()
    if not there.any():
        out["tokens"], out["documents"], extra = 0, 0, np.zeros(1, np.int64)
    out["source_tokens"], out["repeats"], out["extra"] = has, repeats, extra
    out["reached_tokens"], out["cannot_reach"] = repeats * has + int((extra[: len(lengths)] * lengths).sum()), bool(cannot)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source in plain form, tokens); what is sized already stays as it is."""
    if docs.columns == ["doc_id", "source", "tokens"]:
        return docs
    return docs.select("doc_id", plain_source(F.col("source")).alias("source"), text_tokens(F.col("text")).alias("tokens"))


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (mix, source, exact length): how often all its documents are used, and how many once more.

    Only the histogram (source, length, count) is gathered; its rows are bounded by sources x distinct lengths. Each
    (mix, source) is fitted by itself. Targets with a null mix, source, weight, size or cap are left out, negative weights
    count as 0; repeated target rows count once. A source that does not occur gets one row with no documents.
    """
    histogram = written(sized(docs).groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("documents")), "lengths")
    total = histogram.agg(F.coalesce(F.sum(F.col("tokens") * F.col("documents")), F.lit(0)).alias("all_tokens"))
    known = targets.select("mix_id", plain_source(F.col("source")).alias("source"), "weight", "max_repeats", "size_factor").dropna()
    wanted = known.withColumn("weight", F.greatest("weight", F.lit(0.0))).distinct()
    sums = wanted.groupBy("mix_id").agg(F.sum("weight").alias("sum_weight"))
    goal = F.when(F.col("sum_weight") > 0, F.col("weight") / F.col("sum_weight") * F.col("size_factor") * F.col("all_tokens")).otherwise(F.lit(0.0))
    goals = wanted.join(sums, "mix_id").join(total, how="cross").select("mix_id", "source", "weight", "max_repeats", goal.alias("target_tokens"))  # total is one row
    rows = goals.join(histogram.hint("merge"), "source", "left").withColumn("source_tokens", F.lit(0).cast("long"))
    return rows.groupBy("mix_id", "source").applyInPandas(_plan, PLAN)


def report(planned: DataFrame) -> DataFrame:
    """Target and reached shares per (mix, source)."""
    rows = planned.groupBy("mix_id", "source").agg(*[F.first(c).alias(c) for c in ("weight", "max_repeats", "target_tokens", "source_tokens", "reached_tokens", "cannot_reach")])
    sums = rows.groupBy("mix_id").agg(F.sum("target_tokens").alias("_t"), F.sum("reached_tokens").alias("_r"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.join(sums, "mix_id").withColumns({"target_share": share("target_tokens", "_t"), "reached_share": share("reached_tokens", "_r")}).drop("_t", "_r")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(mix_id, source, doc_id, tokens, times): how often each document is used in each mix; unused ones are left out.

    Documents of one source and length are put in seeded order; each mix takes its number of extra uses from another
    place of that order, round the end. The order is found with salts, so no group is numbered in one task.
    Null and empty texts add nothing and are used as often as the whole source is.
    """
    sizes = written(sized(docs), "sizes")  # the texts are read once
    planned = plan(sizes, targets).where((F.col("repeats") > 0) | (F.col("extra") > 0)).select("mix_id", "source", "tokens", "documents", "repeats", "extra")
    ranked = salted_rank(sizes.where(F.col("source").isNotNull()), ["source", "tokens"], F.xxhash64(F.lit(seed), "doc_id"), ["doc_id"])
    place = F.pmod(F.col("rank") + F.pmod(F.xxhash64("mix_id", "source", "tokens"), F.col("documents")), F.col("documents"))
    times = F.col("repeats") + F.when(place < F.col("extra"), 1).otherwise(0)
    return ranked.join(planned, ["source", "tokens"]).select("mix_id", "source", "doc_id", "tokens", times.cast("int").alias("times")).where("times > 0")
