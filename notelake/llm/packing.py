"""Filling fixed-capacity containers: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.ranks import salted_rank, text_tokens
from notelake.session import written

#: Tokens that a container holds.
CAPACITY = 8192

ITEM = "doc_id long, piece int, pieces int, start long, tokens long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """argmin |ax - b| over x >= 0, by the active-set method of Lawson and Hanson.

    After ``rounds`` patterns have come in, the fit is as it is then: still non-negative, and each round has bettered it. It
    is rounded and its residuals are packed anyway, so no item depends on where it stops.
    """
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * scale:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12 * scale) & low]
            x[gone] = 0
            used[gone] = False
            if not used.any():
                break
    return x


def patterns(counts: np.ndarray, most: int = 3, sampled: int = 9000, longest: int = 12, seed: int = 7) -> list[tuple[int, ...]]:
    """Multisets of length classes that fill a container of ``len(counts) - 1`` classes.

    All that have at most ``most`` members and fill it exactly, one member alone for each class, and ``sampled``
    larger ones: members drawn as often as the histogram has them, the last one closing the gap.
    """
    full, have = len(counts) - 1, [int(c) for c in np.flatnonzero(counts) if c > 0]
    is_there = counts > 0
    out: set[tuple[int, ...]] = {(c,) for c in have}
    for i, a in enumerate(have):
        if a < full and is_there[full - a] and a <= full - a:
            out.add((full - a, a))
        if most >= 3:
            for b in have[i:]:
                c = full - a - b
                if c < b:
                    break
                if is_there[c]:
                    out.add((c, b, a))
    if have:
        rng = np.random.default_rng(seed)
        share = counts[have] / counts[have].sum()
        draws = rng.choice(have, size=(sampled, longest), p=share)
        for row in draws:
            total, members = 0, []
            for c in map(int, row):
                if total + c > full:
                    break
                total += c
                members.append(c)
            gap = full - total
            if gap and is_there[gap]:
                members.append(gap)
            elif gap:
                fill = [c for c in have if c <= gap]
                if fill:
                    members.append(fill[-1])
            out.add(tuple(sorted(members, reverse=True)))
    return sorted(out)


def fit(counts: np.ndarray, **options: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): every item of the histogram is in exactly one container.

    ``counts[c]`` items have length class c; a container holds ``len(counts) - 1`` classes. Repeats are the
    rounded-down least-squares fit, cut where a class runs out. What is left is packed best-fit-decreasing on counts
    (whole groups of equal containers at a time), so the work depends on the number of classes, not of items.
    """
    full, left = len(counts) - 1, counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        forms = patterns(left, **options)
        a = np.zeros((full + 1, len(forms)))
        for j, p in enumerate(forms):
            np.add.at(a[:, j], list(p), 1)
        weight = np.sqrt(np.arange(full + 1) / full)  # an unplaced long item costs more than a short one
        x = nnls(a * weight[:, None], left * weight)
        for j in np.argsort(-x, kind="stable"):
            classes, need = np.unique(forms[j], return_counts=True)
            times = min(int(x[j]), int((left[classes] // need).min()))
            if times > 0 and sum(forms[j]) >= 0.97 * full:
                left[classes] -= need * times
                out.append((forms[j], times))
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # free classes -> (members, containers)
    for c in range(full, 0, -1):
        n = int(left[c])
        for space in sorted(s for s in opened if s >= c):
            for each in range(space // c, 0, -1):  # as many of this class in a container as fit, then one fewer
                groups, kept = opened.pop(space, []), []
                for members, k in groups:
                    take = min(k, n // each)
                    if take:
                        opened.setdefault(space - each * c, []).append((members + (c,) * each, take))
                        n -= take * each
                    if k > take:
                        kept.append((members, k - take))
                if kept:
                    opened.setdefault(space, []).extend(kept)
        each = full // c
        if n // each:
            opened.setdefault(full - each * c, []).append(((c,) * each, n // each))
        if n % each:
            opened.setdefault(full - (n % each) * c, []).append(((c,) * (n % each), 1))
    return out + [g for groups in opened.values() for g in groups]


def _cut(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One item per row that fits (its text doesn't come along), several for the others."""
    names, kinds = ["doc_id", "piece", "pieces", "start", "tokens"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    for b in batches:
        large = b.column("text").is_valid()
        fits = b.filter(pc.invert(large))
        n = fits.num_rows
        yield pa.RecordBatch.from_arrays([fits.column("doc_id"), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)), fits.column("tokens")], names)
        rows: list[tuple] = []
        oversized = b.filter(large)
        for i, text in zip(oversized.column("doc_id").to_pylist(), oversized.column("text").cast(pa.binary()).to_pylist()):
            cuts = [0]
            while len(text) - cuts[-1] > capacity:
                end = cuts[-1] + capacity
                while end > cuts[-1] + capacity - 4 and text[end] & 0xC0 == 0x80:  # never inside a character
                    end -= 1
                cuts.append(end)
            cuts.append(len(text))
            rows += [(i, k, len(cuts) - 1, s, e - s) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def items(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, pieces, start, tokens): a text is one item unless it alone is larger than a container. One pass over the texts; only oversized ones leave the JVM."""
    size = text_tokens(F.col("text"))
    return docs.select("doc_id", size.alias("tokens"), F.when(size > capacity, F.col("text")).alias("text")).mapInArrow(partial(_cut, capacity=capacity), ITEM)


def pack(docs: DataFrame, capacity: int = CAPACITY, width: int = 32) -> DataFrame:
    """(doc_id, piece, pieces, start, tokens, container) for every row of ``docs`` (doc_id, text).

    Lengths are rounded up to classes of ``width`` tokens, so no container overflows. Only the histogram of classes
    (capacity / width + 1 rows, whatever the data) comes to the driver; the fitted plan goes back as intervals of
    positions within a class, and every item finds its container by its position. Null and empty texts take no
    space and go to container 0. Repeated rows are items of their own. No rows, no containers. Columns other than
    doc_id and text are not read.
    """
    spark, classes = docs.sparkSession, -(-capacity // width)
    if capacity % width:
        raise ValueError("capacity must be a multiple of width")
    all_items = written(items(docs, capacity).withColumn("class", F.ceil(F.col("tokens") / width).cast("int")), "items")
    histogram = np.zeros(classes + 1, np.int64)
    for r in all_items.groupBy("class").count().collect():
        histogram[r["class"]] = r["count"]
    intervals: list[tuple[int, int, int, int]] = [(0, 0, int(histogram[0]), -1)]
    filled, container = np.zeros(classes + 1, np.int64), 0
    for members, times in fit(histogram):
        for c in members:
            intervals.append((c, int(filled[c]), int(filled[c]) + times, container))
            filled[c] += times
        container += times
    # at most (classes + residual groups) x members rows: bounded by the number of classes, so it may be broadcast
    plan = spark.createDataFrame(intervals, "class int, from_rank long, to_rank long, base long")
    ranked = salted_rank(all_items, ["class"], F.xxhash64("doc_id", "piece"), ["doc_id", "piece"])
    at = F.when(F.col("base") < 0, F.lit(0)).otherwise(F.col("base") + F.col("rank") - F.col("from_rank"))
    hit = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return ranked.join(F.broadcast(plan), "class").where(hit).select("doc_id", "piece", "pieces", "start", "tokens", at.cast("long").alias("container"))


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of space that is used. Containers are summed in two steps, so none is hot."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("used"),
    )
