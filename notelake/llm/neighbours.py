"""Most similar vectors: score-aware (anisotropic) quantisation, four-bit table scans of the cells near a query, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.cells import Layout, by_model, cells_for, centers_of, homes, matrix, model_counts, nearest_center, sampled

#: Rows per model, of the sample on which cells are fitted, on which codebooks are; every row is then indexed.
TRAINING_ROWS = 6_000
#: Rows of a cell, at least, on the mean: smaller ones aren't worth being passed over.
CELL_ROWS = 1024
#: Share of the sample's own nearest rows that the cells near a query must hold (the table is denser, so it is more there), and the queries that it is measured with.
RECALL, PROBES = 0.99, 512
#: Inner products from this on are those whose error matters (the threshold of the score-aware loss).
SCORE_THRESHOLD = 0.2
#: Rows of a block of the index.
BLOCK_ROWS = 131_072
LEVELS = 16
#: Queries and rows whose scores are held at once, groups of rows whose best score stands for them when the k-th best is looked for, and candidates that wait for reranking.
TILE, GROUPS, WAITING = (4096, 2048), 64, 500_000

HITS = "query string, id string, similarity double"
PLACED = "block int, kind int, cell int, model_name string, id string, path long, unit binary, codes binary"


class Codebook:
    """Per dimension, 16 levels; ``margin`` is how far a scan's score may lie from the exact one (a quantile of what training rows show).

    The loss of coding x (unit) as x + e is |e|^2 + (w - 1) (e.x)^2: error parallel to x, which shifts the scores of
    just those queries that x answers, costs w times as much as error across it.
    """

    def __init__(self, levels: np.ndarray, weight: float, margin: float):
        self.levels, self.weight, self.margin = levels, weight, margin

    @staticmethod
    def parallel_weight(width: int, threshold: float = SCORE_THRESHOLD) -> float:
        return max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))

    @classmethod
    def fit(cls, x: np.ndarray, sweeps: int = 3, quantile: float = 0.997, seed: int = 5) -> Codebook:
        n, width = x.shape
        levels = np.quantile(x, (np.arange(LEVELS) + 0.5) / LEVELS, axis=0).T.astype(np.float64)  # width x 16
        book = cls(levels, cls.parallel_weight(width), 0.0)
        for _ in range(sweeps):
            codes = book.encode(x)
            approx = book.decode(codes).astype(np.float64)
            along = np.einsum("ij,ij->i", approx - x, x)
            for d in range(width):  # least squares for the levels of one dimension, the others fixed
                xd, c = x[:, d].astype(np.float64), codes[:, d]
                rest = along - (approx[:, d] - xd) * xd
                w = 1 + (book.weight - 1) * xd * xd
                top = xd + (book.weight - 1) * xd * (xd * xd - rest)
                den = np.bincount(c, w, LEVELS)
                num = np.bincount(c, top, LEVELS)
                new = np.where(den > 0, num / np.maximum(den, 1e-12), book.levels[d])
                order = np.argsort(new, kind="stable")
                book.levels[d] = new[order]
                back = np.empty(LEVELS, np.int64)
                back[order] = np.arange(LEVELS)
                codes[:, d] = back[c]
                approx[:, d] = book.levels[d][codes[:, d]]
                along = rest + (approx[:, d] - xd) * xd
        rng = np.random.default_rng(seed)
        a, b = rng.integers(0, n, 20_000), rng.integers(0, n, 20_000)
        error = np.abs(np.einsum("ij,ij->i", (book.decode(book.encode(x))[b] - x[b]).astype(np.float64), x[a].astype(np.float64)))
        book.margin = 2 * float(np.quantile(error, quantile)) if n else 0.0
        return book

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Nearest levels first, then one pass of coordinate descent on the score-aware loss between each level and its neighbours."""
        n, width = x.shape
        codes = np.empty((n, width), np.uint8)
        for d in range(width):
            codes[:, d] = np.searchsorted((self.levels[d, 1:] + self.levels[d, :-1]) / 2, x[:, d])
        levels = self.levels.astype(np.float32)
        approx = levels[np.arange(width), codes]
        along = np.einsum("ij,ij->i", approx - x, x)
        extra = np.float32(self.weight - 1)
        for d in range(width):
            xd, at = x[:, d], approx[:, d]
            best = (at - xd) ** 2 + extra * along * along
            for step in (-1, 1):
                c = np.clip(codes[:, d].astype(np.int16) + step, 0, LEVELS - 1).astype(np.uint8)
                lv = levels[d][c]
                moved = along + (lv - approx[:, d]) * xd
                loss = (lv - xd) ** 2 + extra * moved * moved
                win = loss < best
                best = np.where(win, loss, best)
                along = np.where(win, moved, along)
                codes[:, d] = np.where(win, c, codes[:, d])
                approx[:, d] = np.where(win, lv, approx[:, d])
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.levels.astype(np.float32)[np.arange(codes.shape[1]), codes]


def nibbles(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes per byte."""
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def from_nibbles(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


class Index:
    """What all tasks know of one model: its codebook, the layout of its cells, how many of them a query visits, and the number of its first block."""

    def __init__(self, book: Codebook, layout: Layout, probes: int, first: int):
        self.book, self.layout, self.probes, self.first = book, layout, probes, first
        self.width = len(book.levels)

    def visited(self, q: np.ndarray) -> np.ndarray:
        """Which cells each query visits: the nearest ones."""
        score = q @ self.layout.units.T
        if self.probes >= score.shape[1]:
            return np.ones(score.shape, bool)
        return score >= np.partition(score, score.shape[1] - self.probes, axis=1)[:, score.shape[1] - self.probes, None] - np.float32(1e-6)


def probes_for(x: np.ndarray, units: np.ndarray, k: int) -> int:
    """How many of its nearest cells a row must visit so that these hold RECALL of the ``k`` rows of ``x`` that are nearest to it; all, where there are too few rows to tell."""
    if len(x) < 4 * k + 20 or len(units) < 8:
        return len(units)
    at = np.unique(np.linspace(0, len(x) - 1, PROBES).astype(np.int64))
    cell, need = nearest_center(x, units), []
    for s in range(0, len(at), 64):
        rows = at[s : s + 64]
        score = x[rows] @ x.T
        score[np.arange(len(rows)), rows] = -2
        best = np.argpartition(-score, k, axis=1)[:, :k]
        to = x[rows] @ units.T
        need.append((to[:, None, :] > np.take_along_axis(to, cell[best], axis=1)[:, :, None]).sum(axis=2))
    return min(len(units), int(np.quantile(np.concatenate(need).ravel(), RECALL, method="higher")) + 1)


def _place(batches: Iterator[pa.RecordBatch], indexes: dict[str, Index]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, each with its codes to the block of its cell."""
    for b in batches:
        keys = b.column("key").to_numpy()
        for model, mine, x in by_model(b, {m: i.width for m, i in indexes.items()}):
            i, at = indexes[model], pa.array(mine)
            cell = nearest_center(x, i.layout.units)
            block = i.first + i.layout.home(cell, keys[mine])
            codes = [row.tobytes() for row in nibbles(i.book.encode(x))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), pa.array(np.zeros(len(mine), np.int32)), pa.array(cell.astype(np.int32)), *[b.column(c).take(at) for c in ("model_name", "id", "path", "unit")], pa.array(codes, pa.binary())],
                [c.split()[0] for c in PLACED.split(", ")],
            )


def _ask(batches: Iterator[pa.RecordBatch], indexes: dict[str, Index]) -> Iterator[pa.RecordBatch]:
    """Queries, each to the blocks that its cells reach into."""
    for b in batches:
        for model, mine, x in by_model(b, {m: i.width for m, i in indexes.items()}):
            i = indexes[model]
            for s in range(0, len(mine), 1024):
                who, block = np.nonzero(i.visited(x[s : s + 1024]).astype(np.float32) @ i.layout.reaches.astype(np.float32) > 0)
                at = pa.array(mine[s + who])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((i.first + block).astype(np.int32)), pa.array(np.ones(len(who), np.int32)), pa.array(np.zeros(len(who), np.int32)), *[b.column(c).take(at) for c in ("model_name", "id", "path", "unit")], pa.nulls(len(who), pa.binary())],
                    [c.split()[0] for c in PLACED.split(", ")],
                )


class _Block:
    """The rows of one block of the index, in order of their cells and files, and the scan over their codes."""

    def __init__(self, index: Index, parts: list[tuple], k: int):
        self.index, self.book, self.k = index, index.book, k
        path, cell = np.concatenate([p[1] for p in parts]), np.concatenate([p[4] for p in parts])
        order = np.lexsort((path, cell))
        self.path = path[order]
        self.cells, begin = np.unique(cell[order], return_index=True)
        self.bounds = np.append(begin, len(order))
        self.ids = np.array([i for p in parts for i in p[0]], object)[order]
        self.at = {i: j for j, i in enumerate(self.ids)}
        self.by_id = np.empty(len(self.ids), np.int64)  # each row's place by id, as the window outside sorts
        self.by_id[sorted(range(len(self.ids)), key=lambda j: self.ids[j].encode())] = np.arange(len(self.ids))
        self.unit = np.concatenate([p[2] for p in parts])[order]
        self.codes = np.concatenate([p[3] for p in parts])[order]

    def scan(self, s: int, e: int) -> np.ndarray:
        """The levels that some rows' codes stand for: looked up once for all queries, they make the table scan one matrix product."""
        return self.book.decode(from_nibbles(self.codes[s:e]))

    def _best(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact similarity) of the first k rows of each query, by similarity, then by id."""
        rough = np.empty(len(a), np.float32)
        for c in range(0, len(a), 100_000):
            rough[c : c + 100_000] = np.einsum("ij,ij->i", q[a[c : c + 100_000]], self.unit[b[c : c + 100_000]])
        order = np.lexsort((-rough, a))
        a, b, rough = a[order], b[order], rough[order]
        last = np.minimum(np.searchsorted(a, a, side="left") + self.k, np.searchsorted(a, a, side="right")) - 1
        near = rough >= rough[last] - np.float32(4e-6)  # single precision leaves out what can't be one of the first k
        a, b = a[near], b[near]
        exact = np.empty(len(a))
        for c in range(0, len(a), 100_000):
            exact[c : c + 100_000] = np.einsum("ij,ij->i", q[a[c : c + 100_000]].astype(np.float64), self.unit[b[c : c + 100_000]].astype(np.float64))
        order = np.lexsort((self.by_id[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a, side="left") < self.k
        return a[keep], b[keep], exact[keep]

    def search(self, ids: np.ndarray, path: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, len(ids), TILE[0]):
            a, b, exact = self._search(ids[s : s + TILE[0]], path[s : s + TILE[0]], unit[s : s + TILE[0]])
            yield ids[s + a], self.ids[b], exact

    def _search(self, ids: np.ndarray, path: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.k
        own = np.array([self.at.get(i, -1) for i in ids], np.int64)
        visited = self.index.visited(q)[:, self.cells]
        low = np.full(len(q), -1.5, np.float32)
        top = np.full((len(q), k), -1.5, np.float32)  # scores of the best groups so far; the least of them is at most the k-th best score
        a, b, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        tiles = [(c, s, min(int(self.bounds[c + 1]), s + TILE[1])) for c in range(len(self.cells)) for s in range(int(self.bounds[c]), int(self.bounds[c + 1]), TILE[1])]
        for c, s, e in tiles:
            rows = np.flatnonzero(visited[:, c])
            if not len(rows):
                continue
            found = q[rows] @ self.scan(s, e).T
            p = path[rows]
            begin, end = np.searchsorted(self.path[s:e], p, side="left"), np.searchsorted(self.path[s:e], p, side="right")
            for i in np.flatnonzero((end > begin) & (p != 0)):  # no path is no shared file
                found[i, begin[i] : end[i]] = -2.0
            mine = np.flatnonzero((own[rows] >= s) & (own[rows] < e))
            found[mine, own[rows[mine]] - s] = -2.0
            groups = min(e - s, max(GROUPS, k + 1))
            whole = (e - s) // groups * groups
            heads = np.concatenate([top[rows], found[:, :whole].reshape(len(rows), -1, groups).max(axis=1), found[:, whole:]], axis=1)
            top[rows] = np.partition(heads, heads.shape[1] - k, axis=1)[:, heads.shape[1] - k :]
            low[rows] = np.maximum(top[rows].min(axis=1) - self.book.margin, np.float32(-1.5))
            x, y = np.nonzero(found >= low[rows][:, None])
            a, b, score = np.append(a, rows[x]), np.append(b, y + s), np.append(score, found[x, y])
            if len(a) > WAITING:
                a, b, score = self._reranked(q, a, b, score, low)
        a, b, _ = self._reranked(q, a, b, score, low)
        return self._best(q, a, b)

    def _reranked(self, q: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = score >= low[a]
        a, b, _ = self._best(q, a[near], b[near])
        return a, b, np.full(len(a), 2, np.float32)  # stays in, whatever the later limits are


def _scan(batches: Iterator[pa.RecordBatch], indexes: dict[str, Index], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block, in each block first the index's rows, then the queries; queries stream through."""
    block, parts, model, at = None, [], "", None

    def column(b: pa.RecordBatch, model: str) -> tuple:
        width = indexes[model].width
        index = b.column("codes").null_count == 0
        return (
            np.array(b.column("id").to_pylist(), object), b.column("path").to_numpy(zero_copy_only=False), matrix(b.column("unit"), np.float32, width),
            matrix(b.column("codes"), np.uint8, width // 2) if index else None, b.column("cell").to_numpy().astype(np.int64),
        )

    for batch in batches:
        where = batch.column("block").to_numpy(zero_copy_only=False) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(where)) + 1), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            if a == z:
                continue
            piece = batch.slice(a, z - a)
            if where[a] // 2 != at:
                at, parts, block = where[a] // 2, [], None
                model = piece.column("model_name")[0].as_py()
            if where[a] % 2 == 0:
                parts.append(column(piece, model))
            elif parts:
                block = block or _Block(indexes[model], parts, k)
                ids, path, unit, _, _ = column(piece, model)
                for found in block.search(ids, path, unit):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], ["query", "id", "similarity"])


def nearest(usable: DataFrame, wanted: DataFrame, k: int = 5, seed: int = 3) -> DataFrame:
    """(query, id, similarity, rank): for each wanted id among the usable entries its ``k`` most similar entries of the same model
    in other files, by cosine, ties by id.

    ``usable`` is (id, model_name, file_path, unit), best read from a written table: it is passed over four times.
    Cells are fitted on a bounded sample, as many as the square root of the rows but of no fewer than CELL_ROWS on the mean, codebooks on about TRAINING_ROWS rows of it; every row is indexed, in
    the cell nearest to it, as 4 bits per dimension. Cells lie in blocks of equal size; each task holds one block, and a query goes to the blocks of the cells
    nearest to it, so neither side is gathered or broadcast. How many cells these are is measured on the sample: so many that they hold RECALL of the rows nearest
    to a row. Where vectors spread over all directions that is all of them. A scan scores the rows of these cells from the codes; rows whose score is within the
    codebook's margin of the block's k-th best so far are reranked exactly, however many they are, by (similarity, id). The
    loss: a neighbour is missed if it lies in none of these cells, or if its score errs by more than the margin (README has measured recall).

    A null path is no shared file. Fewer than k rows come back where fewer entries exist (or lie in the cells visited). Wanted ids that are null, unknown or repeated
    add nothing. Empty tables give no rows.
    """
    spark = usable.sparkSession
    counts = model_counts(usable)
    samples = sampled(usable, counts, seed)
    if not samples:
        return spark.createDataFrame([], HITS + ", rank int")
    units = {m: centers_of(x, max(1, min(cells_for(counts[m]), counts[m] // CELL_ROWS))) for m, x in samples.items()}
    sizes, least = homes(usable, units)
    indexes, total = {}, 0
    for m, x in samples.items():
        layout = Layout(units[m], sizes[m], least[m], BLOCK_ROWS, 2 * spark.sparkContext.defaultParallelism, 2048)
        book = Codebook.fit(x[:: max(1, len(x) // TRAINING_ROWS)])
        indexes[m], total = Index(book, layout, probes_for(x, layout.units, k), total), total + layout.blocks
    path = F.when(F.col("file_path").isNull(), F.lit(0)).otherwise(F.xxhash64("file_path")).alias("path")
    rows = usable.select("model_name", "id", path, "unit", F.xxhash64("id").alias("key"))
    asked = rows.join(wanted.select("id").where(F.col("id").isNotNull()).distinct(), "id", "left_semi").select(*rows.columns)
    placed = rows.mapInArrow(partial(_place, indexes=indexes), PLACED).unionByName(asked.mapInArrow(partial(_ask, indexes=indexes), PLACED))
    hits = placed.repartitionById(total, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(partial(_scan, indexes=indexes, k=k), HITS)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs of ids, the smaller first."""
    return found.select(F.least("query", "id").alias("entry_a"), F.greatest("query", "id").alias("entry_b")).distinct()
