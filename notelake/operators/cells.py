"""Cells of unit vectors: centers fitted on a bounded sample, every row in the cell of its nearest center, cells laid out in blocks of equal size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a model on which centers are fitted: so many per cell, and at most the last (but for the chance of a hash). Every row is then placed.
SAMPLE_EACH, SAMPLE_ROWS = 40, 65_536
#: Cells of a model: the square root of its rows, at most the last.
MOST_CELLS = 16_384
#: Rows that are scored against all centers at once.
STEP = 1024
#: What single precision, and codes of sixteen bits, may add to the error of a cosine with a center.
SLACK = 2e-4

HOMES = "model_name string, cell int, n long, least double"


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def cells_for(rows: int) -> int:
    return max(1, min(MOST_CELLS, math.isqrt(max(0, rows - 1)) + 1))


def model_counts(usable: DataFrame) -> dict[str, int]:
    """Rows per model, in order of the model's name; one row per model is collected."""
    return {r["model_name"]: r["count"] for r in sorted(usable.groupBy("model_name").count().collect(), key=lambda r: r["model_name"])}


def sampled(usable: DataFrame, counts: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """Unit rows of each model's sample, in order of the id: rows whose id hashes low, so the same ones in every run."""
    if not counts:
        return {}
    whole = 1_000_003
    share = {m: min(1.0, SAMPLE_EACH * cells_for(n) / n, SAMPLE_ROWS / n) for m, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for m, s in share.items() for x in (m, int(s * whole) + 1)])[F.col("model_name")]
    rows = usable.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(whole)) < limit).select("model_name", "id", "unit").collect()
    rows.sort(key=lambda r: r["id"])
    out = {}
    for m in counts:
        mine = [bytes(r["unit"]) for r in rows if r["model_name"] == m]
        if mine:
            out[m] = np.frombuffer(b"".join(mine), np.float32).reshape(len(mine), -1)
    return out


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[s : s + STEP] @ centers.T).argmax(axis=1) for s in range(0, len(x), STEP)]) if len(x) else np.empty(0, np.int64)


def centers_of(x: np.ndarray, count: int, start: np.ndarray | None = None, rounds: int = 6) -> np.ndarray:
    """Unit centers by spherical k-means, begun with ``start`` and rows spread over ``x``."""
    first = np.empty((0, x.shape[1]), np.float32) if start is None else start[:count]
    more = max(0, min(count, len(x)) - len(first))
    c = np.concatenate([first, x[np.linspace(0, len(x) - 1, more).astype(np.int64)]]) if more else first.copy()
    for _ in range(rounds):
        cell = nearest_center(x, c)
        order = np.argsort(cell, kind="stable")
        there, begin = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), begin, axis=0)
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        good = size > 1e-9
        c = c.copy()
        c[there[good]] = (sums[good] / size[good][:, None]).astype(np.float32)
    return c


def may_reach(x: np.ndarray, own: np.ndarray, units: np.ndarray, least: np.ndarray, threshold: np.ndarray | float) -> np.ndarray:
    """Which cells (centers ``units``, with a member whose cosine with its center is ``least``) may hold rows whose cosine with each row of ``x`` is at
    least the threshold (one, or one of each row). ``own`` is each row's own center, the nearest to it.

    Exact, by two bounds. Two rows no farther apart than r = sqrt(2 - 2 t), whose nearest centers are c and d: the first is at most r on c's side of the
    plane between c and d. And the angle between a row and d is at most the threshold's more than that of d's farthest row.
    """
    t = np.broadcast_to(np.clip(np.asarray(threshold, np.float32), -1, 1), len(x))
    score = x @ units.T
    apart = np.sqrt(np.maximum(0, 2 - 2 * (own @ units.T)))
    plane = np.einsum("ij,ij->i", x, own)[:, None] - score <= np.sqrt(2 - 2 * t)[:, None] * apart + 2 * SLACK
    reach = np.arccos(np.clip(least - SLACK, -1, 1)).astype(np.float32)[None, :] + np.arccos(t)[:, None]
    return plane & ((reach >= np.pi) | (score >= np.cos(np.minimum(reach, np.float32(np.pi))) - SLACK))


class Layout:
    """The cells of one model, in an order in which neighbours follow each other, and the blocks that this order is cut into.

    Blocks have equal numbers of rows, whatever the cells hold: a cell's rows are spread over its stretch by a hash, and a
    large cell reaches over several blocks.
    """

    def __init__(self, units: np.ndarray, counts: np.ndarray, least: np.ndarray, block_rows: int, least_blocks: int, small: int):
        order, left = [0], np.ones(len(units), bool)
        left[0] = False
        for _ in range(len(units) - 1):  # a chain from each center to the nearest one that is left
            order.append(int(np.where(left, units @ units[order[-1]], -2).argmax()))
            left[order[-1]] = False
        self.units, n = np.ascontiguousarray(units[order]), counts[order]
        self.least = least[order]
        self.ends = np.cumsum(n)
        self.starts, total = self.ends - n, int(n.sum())
        self.blocks = max(1, -(-total // block_rows), min(-(-total // small), least_blocks))
        self.length = max(1, -(-total // self.blocks))
        inside = np.arange(self.blocks)[None, :]
        #: which cells reach into which blocks
        self.reaches = ((self.starts // self.length)[:, None] <= inside) & (inside <= (np.maximum(self.ends - 1, 0) // self.length)[:, None]) & (n > 0)[:, None]

    def home(self, cell: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The block of each row, by its cell and a hash of its own."""
        share = (keys.view(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return np.minimum(self.starts[cell] + (share * (self.ends - self.starts)[cell]).astype(np.int64), np.maximum(self.ends[cell] - 1, 0)) // self.length


def by_model(b: pa.RecordBatch, widths: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(model, row numbers, unit rows) of a batch."""
    names = np.array(b.column("model_name").to_pylist(), object)
    for model, width in widths.items():
        mine = np.flatnonzero(names == model)
        if len(mine):
            yield model, mine, matrix(b.column("unit").take(pa.array(mine)), np.float32, width)


def _homes(batches: Iterator[pa.RecordBatch], units: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of each cell, and the least cosine of one with its center."""
    n, least = {m: np.zeros(len(u), np.int64) for m, u in units.items()}, {m: np.ones(len(u)) for m, u in units.items()}
    for b in batches:
        for model, _, x in by_model(b, {m: u.shape[1] for m, u in units.items()}):
            cell = nearest_center(x, units[model])
            n[model] += np.bincount(cell, minlength=len(n[model]))
            np.minimum.at(least[model], cell, np.einsum("ij,ij->i", x, units[model][cell]).astype(np.float64))
    for m in units:
        at = np.flatnonzero(n[m])
        yield pa.RecordBatch.from_arrays([pa.array([m] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[m][at]), pa.array(least[m][at])], ["model_name", "cell", "n", "least"])


def homes(usable: DataFrame, units: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(rows of each cell, least cosine with its center) of each model, over all rows; models x cells rows are collected."""
    counts, least = {m: np.zeros(len(u), np.int64) for m, u in units.items()}, {m: np.ones(len(u)) for m, u in units.items()}
    found = usable.select("model_name", "unit").mapInArrow(partial(_homes, units=units), HOMES).groupBy("model_name", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    for r in found.collect():
        counts[r["model_name"]][r["cell"]], least[r["model_name"]][r["cell"]] = r["n"], r["least"]
    return counts, least
