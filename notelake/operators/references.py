"""References of similar vectors: greedy seeds in id order and the most similar seed of every other entry, exactly and without a list of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.cells import SAMPLE_EACH, STEP, Layout, cells_for, centers_of, homes, may_reach, nearest_center, sampled
from notelake.session import drop_scratch, scratch, written

#: Entries that one task settles in order.
FEW_ROWS = 8192
#: Rows of ids that are broadcast in place of shuffling vectors to them, at most.
FEW_IDS = 250_000
#: Bytes of a block's unit vectors, which one task holds; blocks where there are rows enough for several tasks, and the rows of the least block.
BLOCK_BYTES, LEAST_BLOCKS, LEAST_ROWS = 64_000_000, 5, 1024
#: Visitors and held rows that are scored at once, rows whose near cells are known at once, pairs that are verified at once.
TILE, SLAB, PAIRS = (512, 2048), 8192, 32_768
#: What single precision may add to the error of a similarity.
ROUNDING = 2e-5

UNITS = "model_name string, id string, unit binary"
PLACED = "block int, side int, cell int, id string, seed boolean, vector {}"
FOUND = "id string, earlier boolean, reference string, similarity double"
REFERENCES = "id string, reference string, similarity double"


def _usable(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, vectors, norms in double) of those vectors that have a cosine."""
    at = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    x = flat.reshape(len(at), width)
    with np.errstate(all="ignore"):
        norm = _norms(x)
        good = (norm * norm > 0) & (norm * norm < np.inf)
    return at[good], x[good], norm[good]


def _norms(x: np.ndarray) -> np.ndarray:
    parts = [x[s : s + SLAB].astype(np.float64) for s in range(0, len(x), SLAB)]
    return np.concatenate([np.sqrt(np.einsum("ij,ij->i", p, p)) for p in parts]) if parts else np.empty(0)


def _units(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for s in range(0, len(x), SLAB):
        out[s : s + SLAB] = x[s : s + SLAB].astype(np.float64) / norm[s : s + SLAB, None]
    return out


def _unit_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, x, norm = _usable(b.column("vector"), width)
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(at), pa.string()), b.column("id").take(pa.array(at)), pa.array([r.tobytes() for r in _units(x, norm)], pa.binary())], ["model_name", "id", "unit"])


def _settled(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """The whole of :func:`best_references` on rows that come in id order."""
    ids, parts = [], []
    for b in batches:
        at, x, norm = _usable(b.column("vector"), width)
        ids += b.column("id").take(pa.array(at)).to_pylist()
        parts.append(x.astype(np.float64) / norm[:, None])
    if not ids:
        return
    unit = np.concatenate(parts)
    taken = np.zeros(len(ids), bool)
    for s in range(0, len(ids), 256):
        near = np.clip(unit[s : s + 256] @ unit.T, -1, 1) >= threshold
        for i in range(len(near)):
            if not taken[s + i]:
                taken[s + i + 1 :] |= near[i, s + i + 1 :]
    members, seeds = np.flatnonzero(taken), np.flatnonzero(~taken)
    for s in range(0, len(members), 256):
        score = unit[members[s : s + 256]] @ unit[seeds].T
        i, j = np.nonzero(score >= score.max(axis=1)[:, None] - 1e-9)
        exact = np.clip(np.einsum("ij,ij->i", unit[members[s + i]], unit[seeds[j]]), -1.0, 1.0)
        order = np.lexsort((j, -exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in members[s + i[first]]], pa.string()), pa.array([ids[k] for k in seeds[j[first]]], pa.string()), pa.array(exact[first])], ["id", "reference", "similarity"])


class _Plan(Layout):
    """Cells in blocks, which of two blocks' rows visit the other, and few directions along which the centers differ most."""

    def __init__(self, units: np.ndarray, counts: np.ndarray, least: np.ndarray, threshold: float, fewer: bool | None):
        width = units.shape[1]
        super().__init__(units, counts, least, max(LEAST_ROWS, BLOCK_BYTES // (4 * width)), LEAST_BLOCKS, LEAST_ROWS)
        self.threshold, step = threshold, np.arange(self.blocks)
        one_way = (step[:, None] < step[None, :]) == ((step[:, None] + step[None, :]) % 2 == 1)
        #: by whether a row is a seed: of two blocks, which one's rows visit the other; where only pairs of a seed and another row matter, the kind that has fewer rows visits all
        self.goes = np.stack([one_way if fewer is None else np.full_like(one_way, fewer is kind) for kind in (False, True)]) & (step[:, None] != step[None, :])
        vectors = np.linalg.eigh(self.units.astype(np.float64).T @ self.units)[1]
        self.directions = np.ascontiguousarray(vectors[:, ::-1][:, : min(width, max(16, width // 4))]).astype(np.float32)

    def near(self, x: np.ndarray, cell: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of ``cells`` may hold rows close to each row, whose own cell is ``cell``."""
        return may_reach(x, self.units[cell], self.units[cells], self.least[cells], self.threshold)

    def outline(self, x: np.ndarray) -> np.ndarray:
        """Few numbers per unit row, whose inner product is never below that of the rows: coordinates along the directions, and the norm of the rest."""
        head = x @ self.directions
        rest = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", head, head)))
        return np.concatenate([head, rest[:, None]], axis=1)


def _place(batches: Iterator[pa.RecordBatch], plan: _Plan) -> Iterator[pa.RecordBatch]:
    """Each row to its home block (side 0), and to those blocks that it visits since they may hold rows close to it (side 1)."""
    reaches = plan.reaches.astype(np.float32)
    for b in batches:
        at, x, norm = _usable(b.column("vector"), plan.units.shape[1])
        unit, keys, seed = _units(x, norm), b.column("key").to_numpy(), b.column("seed").to_numpy(zero_copy_only=False).astype(np.int64)
        for s in range(0, len(at), STEP):
            u = unit[s : s + STEP]
            cell = nearest_center(u, plan.units)
            home = plan.home(cell, keys[at[s : s + STEP]])
            who, block = np.nonzero((plan.near(u, cell).astype(np.float32) @ reaches > 0) & plan.goes[seed[at[s : s + STEP]], home])
            rows = np.append(np.arange(len(u)), who)
            take = pa.array(at[s + rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32)) for c in (np.append(home, block), np.repeat([0, 1], [len(u), len(who)]), cell[rows])] + [b.column(c).take(take) for c in ("id", "seed", "vector")],
                ["block", "side", "cell", "id", "seed", "vector"],
            )


class _Rows:
    """Rows in the order of their cells, and what is known of each."""

    def __init__(self, parts: list[pa.RecordBatch], plan: _Plan):
        self.ids = np.array([i for p in parts for i in p.column("id").to_pylist()], object)
        self.seed, self.cell = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("seed", "cell"))
        self.x = np.concatenate([_usable(p.column("vector"), plan.units.shape[1])[1] for p in parts])
        self.norm = _norms(self.x)
        self.unit = _units(self.x, self.norm)
        self.outline = np.concatenate([plan.outline(self.unit[s : s + SLAB]) for s in range(0, len(self.unit), SLAB)])
        self.cells, begin = np.unique(self.cell, return_index=True)
        self.bounds = np.append(begin, len(self.cell))
        n = len(self.ids)
        #: has a close row (of the other kind, where kinds matter); has an earlier one
        self.partner, self.earlier = np.zeros(n, bool), np.zeros(n, bool)
        self.best, self.known, self.reference = np.full(n, -2.0), np.full(n, -2.0), np.empty(n, object)

    def found(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.partner)
        return pa.RecordBatch.from_arrays([pa.array(list(self.ids[at]), pa.string()), pa.array(self.earlier[at]), pa.array(list(self.reference[at]), pa.string()), pa.array(self.best[at])], ["id", "earlier", "reference", "similarity"])

    def offer(self, rows: np.ndarray, similarity: np.ndarray, references: np.ndarray) -> None:
        """Seeds for rows: the most similar one stays, of equal ones the least."""
        self.partner[rows] = True
        np.maximum.at(self.best, rows, similarity)
        for j in np.flatnonzero(similarity == self.best[rows]):
            r = rows[j]
            if self.known[r] < similarity[j] or references[j] < self.reference[r]:
                self.known[r], self.reference[r] = similarity[j], references[j]


def _exact(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        p, q = i[s : s + PAIRS], j[s : s + PAIRS]
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a.x[p].astype(np.float64) / a.norm[p][:, None], b.x[q].astype(np.float64) / b.norm[q][:, None])
    return np.clip(out, -1.0, 1.0)


def _close(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: single precision where it can tell, else double."""
    score = np.empty(len(i), np.float32)
    for s in range(0, len(i), PAIRS):
        score[s : s + PAIRS] = np.einsum("ij,ij->i", a.unit[i[s : s + PAIRS]], b.unit[j[s : s + PAIRS]])
    close = score >= threshold + ROUNDING
    doubt = np.flatnonzero(~close & (score >= threshold - ROUNDING))
    close[doubt] = _exact(a, i[doubt], b, j[doubt]) >= threshold
    return close


def _first(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, threshold: float) -> None:
    """Of close pairs, both have a partner and the later one has an earlier one. Pairs that would tell nothing new are left out."""
    new = ~(a.earlier[i] & b.earlier[j])
    i, j = i[new], j[new]
    for s in range(0, len(i), PAIRS):
        p, q = i[s : s + PAIRS], j[s : s + PAIRS]
        lower = (a.ids[p] < b.ids[q]).astype(bool)
        new = np.where(lower, ~(a.partner[p] & b.earlier[q]), ~(b.partner[q] & a.earlier[p]))
        p, q, lower = p[new], q[new], lower[new]
        close = _close(a, p, b, q, threshold)
        p, q, lower = p[close], q[close], lower[close]
        a.partner[p] = b.partner[q] = True
        a.earlier[p[~lower]] = True
        b.earlier[q[lower]] = True


def _taken(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, threshold: float) -> None:
    """Of close pairs of a seed and another row, the other has a partner."""
    new = (a.seed[i] & ~b.seed[j] & ~b.partner[j]) | (b.seed[j] & ~a.seed[i] & ~a.partner[i])
    i, j = i[new], j[new]
    close = _close(a, i, b, j, threshold)
    i, j = i[close], j[close]
    a.partner[i[~a.seed[i]]] = True
    b.partner[j[~b.seed[j]]] = True


def _best(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, threshold: float) -> None:
    """Of close pairs of a seed and another row, the other is offered the seed."""
    mixed = a.seed[i] != b.seed[j]
    i, j = i[mixed], j[mixed]
    close = _close(a, i, b, j, threshold)
    i, j = i[close], j[close]
    similarity, of_a = _exact(a, i, b, j), ~a.seed[i]
    a.offer(i[of_a], similarity[of_a], b.ids[j[of_a]])
    b.offer(j[~of_a], similarity[~of_a], a.ids[i[~of_a]])


KINDS = {"first": _first, "taken": _taken, "best": _best}


def _candidates(y: np.ndarray, near: np.ndarray, held: _Rows, low: np.float32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of the outlines ``y``, held row) whose outlines don't rule ``low`` out, in cells that are near the row."""
    for c in np.flatnonzero(near.any(axis=0)):
        mine = np.flatnonzero(near[:, c])
        for s in range(0, len(mine), TILE[0]):
            rows = mine[s : s + TILE[0]]
            for t in range(held.bounds[c], held.bounds[c + 1], TILE[1]):
                score = y[rows] @ held.outline[t : min(int(held.bounds[c + 1]), t + TILE[1])].T
                hit = np.flatnonzero(score.max(axis=1) >= low)
                if len(hit):
                    a, b = np.nonzero(score[hit] >= low)
                    yield rows[hit[a]], b + t


def _compared(batches: Iterator[pa.RecordBatch], plan: _Plan, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, side, cell): a block's own rows are held and compared with each other, visitors stream past them."""
    low, at, parts, held = np.float32(plan.threshold - ROUNDING), None, [], None

    def seen(rows: _Rows, s: int) -> np.ndarray:
        return plan.near(rows.unit[s : s + SLAB], rows.cell[s : s + SLAB], held.cells)

    def within() -> None:
        for s in range(0, len(held.ids), SLAB):
            near = seen(held, s)
            near[:, held.bounds[:-1] >= s + SLAB] = False
            for i, j in _candidates(held.outline[s : s + SLAB], near, held, low):
                once = j < i + s
                KINDS[kind](held, i[once] + s, held, j[once], plan.threshold)

    for batch in batches:
        where = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(where)) + 1), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if where[s] // 2 != at:
                if parts:
                    held = _Rows(parts, plan)
                    within()
                if held is not None:
                    yield held.found()
                at, parts, held = where[s] // 2, [], None
            part = batch.slice(s, e - s)
            if where[s] % 2 == 0:
                parts.append(part)
                continue
            if parts:
                held, parts = _Rows(parts, plan), []
                within()
            if held is None:
                continue
            visitors = _Rows([part], plan)
            for t in range(0, len(visitors.ids), SLAB):
                for i, j in _candidates(visitors.outline[t : t + SLAB], seen(visitors, t), held, low):
                    KINDS[kind](visitors, i + t, held, j, plan.threshold)
            yield visitors.found()
    if parts:
        held = _Rows(parts, plan)
        within()
    if held is not None:
        yield held.found()


def _joined(rows: DataFrame, centers: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """What the comparisons of ``kind`` find of (id, vector, seed): a row of each task that finds anything of an entry. Each two rows that may be close meet in one task."""
    counts, least = homes(rows.mapInArrow(partial(_unit_rows, width=centers.shape[1]), UNITS), {"": centers})
    fewer = None if kind == "first" else rows.where("seed").count() * 2 <= rows.count()
    plan = _Plan(centers, counts[""], least[""], threshold, fewer)
    placed = rows.select("id", "seed", "vector", F.xxhash64("id").alias("key")).mapInArrow(partial(_place, plan=plan), PLACED.format(rows.schema["vector"].dataType.simpleString()))
    return placed.repartitionById(plan.blocks, F.col("block")).sortWithinPartitions("block", "side", "cell").mapInArrow(partial(_compared, plan=plan, kind=kind), FOUND)


def counted(ids: DataFrame) -> DataFrame:
    """A written table of ids for a join with vectors: broadcast where it is small, so that the vectors stay where they are."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def best_references(entries: DataFrame, threshold: float) -> DataFrame:
    """(id, reference, similarity): of the entries that greedy clusters (:func:`notelake.operators.dedup.greedy_clusters`) take as members, the seed most similar to each (ties by id), before or after it in order.

    Entries (id string, vector of one length) must be distinct in both and are read several times; seeds refer to none, so no reference has one itself.
    Close pairs are never listed, for in a group of n entries there are n squared of them. Each entry learns whether it has a close one and whether an earlier one;
    entries without any are done. Then in rounds: an open entry without an earlier open one is a seed, what is close to it is taken, the rest goes on; once no more than
    FEW_ROWS are left, one task goes through them in order. Every taken entry meets the seeds of the first round, and at last those of later ones, if there are any. What a round has shuffled and written is removed.
    """
    spark, paths = entries.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        paths.append(scratch(spark, what))
        return written(df, what, paths[-1], free=True)

    def settled(df: DataFrame) -> DataFrame:
        return df.select("id", "vector").repartition(1).sortWithinPartitions("id").mapInArrow(partial(_settled, threshold=threshold, width=width), REFERENCES)

    def first(df: DataFrame) -> DataFrame:
        return kept(_joined(df.withColumn("seed", F.lit(False)), centers, threshold, "first").groupBy("id").agg(F.max("earlier").alias("earlier")), "near")

    rows = entries.select(F.col("id").cast("string").alias("id"), "vector").where(F.col("id").isNotNull() & (F.size("vector") > 0))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], REFERENCES)
    width = rows.select(F.size("vector").alias("n")).first()["n"]
    if n <= FEW_ROWS:
        return settled(rows)
    sample = sampled(rows.mapInArrow(partial(_unit_rows, width=width), UNITS), {"": n}, 29).get("")
    if sample is None:  # hardly any entry can be compared
        sample = np.eye(1, width, dtype=np.float32)
    centers = centers_of(sample, max(1, min(cells_for(n), -(-len(sample) // SAMPLE_EACH))))
    open_ = close = kept(rows.join(counted(first(rows)), "id").select("id", "vector", (~F.col("earlier")).alias("seed")), "open")
    if close.count() <= FEW_ROWS:
        out = written(settled(close), "references", free=True)
        drop_scratch(*paths)
        return out

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "reference")).alias("m"))
        return written(found.select("id", F.col("m.reference").alias("reference"), (-F.col("m.s")).alias("similarity")), "references", free=True)

    def rest_of(taken: DataFrame) -> DataFrame:
        return kept(open_.where("not seed").select("id", "vector").join(counted(taken), "id", "left_anti"), "rest")

    out = best(_joined(open_, centers, threshold, "best"))
    rest = rest_of(out.select("id"))
    if not (left := rest.count()):  # all seeds are those of the first round
        drop_scratch(*paths)
        return out
    later = []
    while left > FEW_ROWS:
        open_ = kept(rest.join(counted(first(rest)), "id", "left").select("id", "vector", (~F.coalesce("earlier", F.lit(False))).alias("seed")), "open")
        later.append(open_.where("seed").select("id"))
        rest = rest_of(kept(_joined(open_, centers, threshold, "taken").select("id").distinct(), "taken"))
        left = rest.count()
    later.append(rest.select("id").join(settled(rest).select("id"), "id", "left_anti"))
    seeds = kept(reduce(DataFrame.unionByName, later).withColumn("seed", F.lit(True)), "seeds")
    marked = kept(close.where("not seed").drop("seed").join(counted(seeds), "id", "left").select("id", "vector", F.coalesce("seed", F.lit(False)).alias("seed")), "marked")
    both = best(out.select("id", "reference", "similarity").unionByName(_joined(marked, centers, threshold, "best").select("id", "reference", "similarity")))
    drop_scratch(*paths)
    return both
