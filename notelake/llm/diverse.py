"""Choosing a varied subset by distributed farthest-first k-center, and the exact join of close entries over its cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.cells import STEP, Layout, by_model, cells_for, centers_of, homes, matrix, may_reach, model_counts, nearest_center, sampled
from notelake.session import drop_scratch, scratch, written

#: Rows on which one round of farthest-first selection runs; a partition is worked through in such parts.
PART_ROWS = 32_768
#: Representatives that may be pooled on the driver; more are thinned out by further distributed rounds first.
POOL_ROWS = 12_288
#: Entries of the k-center from which the cells of the join begin.
CELLS = 128
#: Rows of a block that one task holds, at most, but for uneven hashes.
BLOCK_ROWS = 262_144
#: Blocks of a model that has rows enough for several tasks.
LEAST_BLOCKS = 5
#: Blocks from which on a block's visitors are shared among several tasks.
MANY_BLOCKS = 64
#: Visitors and held rows that are scored at once, and rows whose near cells are known at once.
TILE, SLAB = (512, 2048), 8192
#: Pairs in doubt that are broadcast, at most.
FEW = 20_000
#: What single precision may add to a similarity's error.
ROUNDING = 1e-5

PICKED = "model_name string, id string, unit binary"
PLACED = "task int, side int, cell int, key long, short binary"
LINK = "a long, b long, sure boolean"


def farthest_first(x: np.ndarray, k: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, cosine of each to the nearest chosen before it): greedy k-center over unit rows, first the row ``start``."""
    k = min(k, len(x))
    out, near = np.empty(k, np.int64), np.full(k, -1.0)
    best = np.full(len(x), -2.0, np.float32)
    j = start
    for i in range(k):
        out[i] = j
        near[i] = -1.0 if i == 0 else best[j]
        np.maximum(best, x @ x[j], out=best)
        best[j] = 2.0
        j = int(best.argmin())
    return out, near


def _select(batches: Iterator[pa.RecordBatch], each: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Representatives of every part of the partition, by model."""
    held: dict[str, list[tuple[list, np.ndarray]]] = {}
    names = ["model_name", "id", "unit"]

    def close(model: str) -> pa.RecordBatch:
        ids = [i for part in held[model] for i in part[0]]
        x = np.concatenate([part[1] for part in held[model]])
        order = np.argsort(np.array(ids, object), kind="stable")  # whatever order rows come in
        at, _ = farthest_first(x[order], each[model])
        rows = [(model, ids[i], x[i].tobytes()) for i in order[at]]
        held[model] = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names)

    for b in batches:
        models = np.array(b.column("model_name").to_pylist(), object)
        for model in each:
            mine = np.flatnonzero(models == model)
            if len(mine):
                part = b.take(pa.array(mine))
                width = len(part.column("unit")[0].as_py()) // 4
                held.setdefault(model, []).append((part.column("id").to_pylist(), matrix(part.column("unit"), np.float32, width)))
                if sum(len(p[0]) for p in held[model]) >= PART_ROWS:
                    yield close(model)
    for model in [m for m, p in held.items() if p]:
        yield close(model)


class Centers:
    """The k-center of each model, chosen from pooled representatives."""

    def __init__(self, usable: DataFrame, size: int):
        counts = model_counts(usable)
        k = {m: min(n, size) for m, n in counts.items()}  # of any part too: it may hold what no other one does
        if (wanted := sum(k.values())) > POOL_ROWS:
            raise ValueError(f"{wanted} entries of all models are asked for; the driver chooses among {POOL_ROWS} at most")
        pool = written(usable.select("model_name", "id", "unit").mapInArrow(partial(_select, each=k), PICKED), "representatives")
        while (n := pool.count()) > POOL_ROWS:  # thin out in further rounds; a part holds at least twice what it hands on
            partitions = -(-n // max(PART_ROWS, 2 * wanted))
            pool = written(pool.repartition(partitions, F.xxhash64("id")).mapInArrow(partial(_select, each=k), PICKED), "representatives")
            if partitions == 1:
                break  # now it is what one or two parts propose
        rows = pool.collect()
        self.ids, self.units, self.near = {}, {}, {}
        for m in sorted(counts):
            mine = sorted((r for r in rows if r["model_name"] == m), key=lambda r: r["id"])
            x = np.frombuffer(b"".join(bytes(r["unit"]) for r in mine), np.float32).reshape(len(mine), -1)
            at, near = farthest_first(x, k[m])
            self.ids[m], self.units[m], self.near[m] = [mine[i]["id"] for i in at], x[at], near


def varied_subset(usable: DataFrame, size: int, threshold: float | None = None) -> DataFrame:
    """(model_name, place, id, similarity_before, crowded): per model ``size`` entries chosen farthest-first, in order of choice.

    Every part of every partition proposes ``size`` representatives of each model (or all its rows), chosen greedily; they are pooled (in
    rounds, while the pool is large, each part again proposing ``size``) and chosen again from the pool. ``similarity_before`` is the
    cosine to the nearest entry chosen earlier; it never falls from one place to the next. So a group closer than ``threshold`` has a second
    member (``crowded``) only after every other kind has one, where fewer kinds than ``size`` exist. Fewer entries than ``size``: all of
    them. Copies add nothing new and come last. A null threshold crowds nothing. Empty table, empty subset. Sizes that make
    more than POOL_ROWS in all raise ValueError.
    """
    centers = Centers(usable, size)
    rows = [(m, i, c, float(s), bool(i and threshold is not None and s >= threshold)) for m in centers.ids for i, (c, s) in enumerate(zip(centers.ids[m], centers.near[m]))]
    return usable.sparkSession.createDataFrame(rows, "model_name string, place int, id string, similarity_before double, crowded boolean")


def _cover(batches: Iterator[pa.RecordBatch], ids: dict[str, list[str]], units: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        models = np.array(b.column("model_name").to_pylist(), object)
        for model, c in units.items():
            mine = np.flatnonzero(models == model)
            if not len(mine):
                continue
            score = matrix(b.column("unit").take(pa.array(mine)), np.float32, c.shape[1]) @ c.T
            best = score.argmax(axis=1)
            near = np.clip(score[np.arange(len(mine)), best].astype(np.float64), -1, 1)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(mine)), pa.array([ids[model][j] for j in best], pa.string()), pa.array(near)], ["id", "representative", "similarity"])


def covered(usable: DataFrame, size: int) -> DataFrame:
    """(id, representative, similarity): every entry with the most similar one of the ``size`` chosen of its model. How well a subset covers the
    data is the least similarity; how large the groups are that it stands for, the count per representative. No shuffle beyond the choice."""
    centers = Centers(usable, size)
    return usable.select("model_name", "id", "unit").mapInArrow(partial(_cover, ids=centers.ids, units=centers.units), "id string, representative string, similarity double")


class _Sets:
    """Disjoint sets over row numbers; the root of a set is its least number. Works on many pairs at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (up := self.parent[r]).size and (up != r).any():
            r = up
        self.parent[x] = r
        return r

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def basis(units: np.ndarray) -> np.ndarray:
    """Orthonormal directions along which rows like ``units`` differ most, a quarter as many as there are dimensions."""
    width = units.shape[1]
    _, vectors = np.linalg.eigh(units.astype(np.float64).T @ units)
    return np.ascontiguousarray(vectors[:, ::-1][:, : min(width, max(16, width // 4))]).astype(np.float32)


def outline(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Few numbers per unit row, whose inner product is never below that of the rows: coordinates along some directions, and the norm of the rest."""
    head = x @ directions
    rest = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", head, head)))
    return np.concatenate([head, rest[:, None]], axis=1)


class Short:
    """Unit rows in sixteen bits a dimension: codes, the step of each row, and how far each row may be from what its codes stand for."""

    def __init__(self, codes: np.ndarray, step: np.ndarray, error: np.ndarray):
        self.codes, self.step, self.error = codes, step, error

    @classmethod
    def of(cls, x: np.ndarray) -> Short:
        step = (np.abs(x).max(axis=1) / 32767).astype(np.float32)
        codes = np.rint(x / np.maximum(step, np.float32(1e-30))[:, None]).astype(np.int16)
        off = x.astype(np.float64) - codes.astype(np.float64) * step[:, None]
        return cls(codes, step, (np.sqrt(np.einsum("ij,ij->i", off, off)) * 1.001).astype(np.float32))

    def packed(self) -> list[bytes]:
        head = np.stack([self.step, self.error], axis=1).view(np.uint8).reshape(len(self.step), 8)
        return [r.tobytes() for r in np.concatenate([head, self.codes.view(np.uint8).reshape(len(self.codes), -1)], axis=1)]

    @classmethod
    def unpacked(cls, column: pa.Array) -> Short:
        raw = matrix(column, np.uint8, len(column[0].as_py()))
        head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
        return cls(np.ascontiguousarray(raw[:, 8:]).view(np.int16), head[:, 0].copy(), head[:, 1].copy())

    @classmethod
    def joined(cls, parts: list[Short]) -> Short:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("codes", "step", "error")))

    def at(self, rows: np.ndarray | slice) -> Short:
        return Short(self.codes[rows], self.step[rows], self.error[rows])

    def rows(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.codes[at] * self.step[at][:, None]

    def __len__(self) -> int:
        return len(self.codes)


class _Held:
    """The rows of one block that are held, their sets, and what is compared with them."""

    def __init__(self, x: Short, cells: np.ndarray, keys: np.ndarray, threshold: float, plan: Plan):
        order = np.argsort(cells, kind="stable")
        self.x, self.keys, self.threshold, self.plan = x.at(order), keys[order], threshold, plan
        self.cells, begin = np.unique(cells[order], return_index=True)
        self.bounds = np.append(begin, len(order))
        self.of = cells[order]
        self.outline, self.sets = self.drawn(self.x), _Sets(len(x))
        self.error = float(x.error.max())
        self.score = np.empty(TILE[0] * TILE[1], np.float32)

    def drawn(self, x: Short) -> np.ndarray:
        return np.concatenate([outline(x.rows(slice(s, s + 8192)), self.plan.directions) for s in range(0, len(x), 8192)])

    def _candidates(self, drawn: np.ndarray, error: float, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``drawn``, held row) whose outlines don't rule the threshold out, in cells that are near the row."""
        low = np.float32(self.threshold - ROUNDING - error - self.error)
        for c in np.flatnonzero(near.any(axis=0)):
            mine = np.flatnonzero(near[:, c])
            for s in range(0, len(mine), TILE[0]):
                rows = mine[s : s + TILE[0]]
                part = drawn[rows]
                for t in range(self.bounds[c], self.bounds[c + 1], TILE[1]):
                    e = min(int(self.bounds[c + 1]), t + TILE[1])
                    score = self.score[: len(rows) * (e - t)].reshape(len(rows), e - t)
                    np.matmul(part, self.outline[t:e].T, out=score)
                    hit = np.flatnonzero(score.max(axis=1) >= low)
                    if len(hit):
                        a, b = np.nonzero(score[hit] >= low)
                        yield rows[hit[a]], b + t

    def _verified(self, y: Short, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (row of ``y``, held row) reach the threshold for sure, and which may reach it."""
        rows, cols = np.unique(a), np.unique(b)
        if len(a) > 0.02 * len(rows) * len(cols):  # dense: one product
            score = (y.rows(rows) @ self.x.rows(cols).T)[np.searchsorted(rows, a), np.searchsorted(cols, b)]
        else:
            score = np.empty(len(a), np.float32)
            for s in range(0, len(a), 32_768):
                score[s : s + 32_768] = np.einsum("ij,ij->i", y.rows(a[s : s + 32_768]), self.x.rows(b[s : s + 32_768]))
        off = y.error[a] + self.x.error[b] + np.float32(ROUNDING)
        sure = score >= self.threshold + off
        return sure, ~sure & (score >= self.threshold - off)

    def _links(self, y: Short, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, held row, sure) of the candidate pairs that may be links. Of a row with a set of held rows at least one sure link, if there is any; else all doubtful ones."""
        pair = a * len(self.x) + self.sets.find(b)
        _, first = np.unique(pair, return_index=True)
        sure, _ = self._verified(y, a[first], b[first])
        found, rest = first[sure], np.flatnonzero(~np.isin(pair, pair[first[sure]]))
        doubt = rest[:0]
        if len(rest):
            sure, may = self._verified(y, a[rest], b[rest])
            found = np.append(found, rest[sure])
            doubt = rest[may]
            doubt = doubt[~np.isin(pair[doubt], pair[found])]
        at = np.append(found, doubt)
        return a[at], b[at], np.arange(len(at)) < len(found)

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Connects the held rows among each other; gives the pairs that stay in doubt."""
        left = []
        for s in range(0, len(self.x), SLAB):
            y = self.x.at(slice(s, s + SLAB))
            top = s + len(y)
            near = self.plan.near(y.rows(), self.of[s:top], self.cells)
            near[:, self.bounds[:-1] >= top] = False
            for a, b in self._candidates(self.outline[s:top], self.error, near):
                new = b < a + s
                a, b = a[new], b[new]
                new = self.sets.find(a + s) != self.sets.find(b)  # what is connected already needs no link
                if new.any():
                    a, b, sure = self._links(y, a[new], b[new])
                    self.sets.merge(a[sure] + s, b[sure])
                    left.append((a[~sure] + s, b[~sure]))
        a, b = (np.concatenate([x[i] for x in left]) if left else np.empty(0, np.int64) for i in (0, 1))
        open_ = self.sets.find(a) != self.sets.find(b)
        return self.keys[a[open_]], self.keys[b[open_]]

    def across(self, y: Short, cells: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(held key, key, sure): one sure link of each row of ``y`` that has any, whereupon the held rows that it links are one set, and its doubtful ones."""
        first, left = np.full(len(y), -1), []
        near = np.concatenate([self.plan.near(y.rows(slice(s, s + SLAB)), cells[s : s + SLAB], self.cells) for s in range(0, len(y), SLAB)])
        for a, b in self._candidates(self.drawn(y), float(y.error.max()), near):
            a, b, sure = self._links(y, a, b)
            left.append((a[~sure], b[~sure]))
            a, b = a[sure], b[sure]
            fresh = first[a] < 0
            first[a[fresh]] = b[fresh]
            self.sets.merge(first[a], b)
        a, b = (np.concatenate([x[i] for x in left]) if left else np.empty(0, np.int64) for i in (0, 1))
        open_ = (first[a] < 0) | (self.sets.find(first[a]) != self.sets.find(b))
        has = np.flatnonzero(first >= 0)
        held, other = np.append(first[has], b[open_]), np.append(has, a[open_])
        return self.keys[held], keys[other], np.arange(len(held)) < len(has)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(smallest key of its set, key) of all held rows but those smallest ones."""
        root = self.sets.find(np.arange(len(self.keys)))
        smallest = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, self.keys)
        linked = smallest[root] != self.keys
        return smallest[root][linked], self.keys[linked]


class Plan(Layout):
    """The layout of a model's cells for the join, and the bounds that say which cells may hold a row's partners."""

    def __init__(self, units: np.ndarray, counts: np.ndarray, least: np.ndarray, threshold: float):
        super().__init__(units, counts, least, BLOCK_ROWS, LEAST_BLOCKS, 4096)
        self.parts = max(1, self.blocks // MANY_BLOCKS)
        self.threshold = threshold
        self.directions = basis(self.units)
        step = np.arange(self.blocks)
        self.goes = (step[:, None] < step[None, :]) == ((step[:, None] + step[None, :]) % 2 == 1)  # of two blocks, which one's rows visit the other
        np.fill_diagonal(self.goes, False)

    def near(self, x: np.ndarray, cell: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of ``cells`` may hold partners of each row, whose own cell is ``cell``."""
        return may_reach(x, self.units[cell], self.units[cells], self.least[cells], self.threshold)

    def visits(self, x: np.ndarray, cell: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether each row visits each block: wherever it may have a partner by what the centers tell."""
        reaches = self.reaches.astype(np.float32)
        near = [self.near(x[s : s + STEP], cell[s : s + STEP]).astype(np.float32) @ reaches > 0 for s in range(0, len(x), STEP)]
        return np.concatenate(near) & self.goes[home]


def _place(batches: Iterator[pa.RecordBatch], plans: dict[str, Plan], first: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Each row to the tasks of its home block (side 0, where the block is compared with itself, or 1) and to those blocks that it visits (side 2)."""
    for b in batches:
        keys = b.column("key").to_numpy()
        for model, mine, x in by_model(b, {m: p.units.shape[1] for m, p in plans.items()}):
            plan, key = plans[model], keys[mine]
            cell = nearest_center(x, plan.units)
            home = plan.home(cell, key)
            part = np.tile(np.arange(plan.parts), len(mine))
            rows = [(np.repeat(mine, plan.parts), first[model] + np.repeat(home, plan.parts) * plan.parts + part, np.minimum(part, 1))]
            who, block = np.nonzero(plan.visits(x, cell, home))
            rows.append((mine[who], first[model] + block * plan.parts + (key[who] % plan.parts), np.full(len(who), 2)))
            at, task, side = (np.concatenate(c) for c in zip(*rows))
            cells = np.zeros(b.num_rows, np.int32)
            cells[mine] = cell
            short = np.empty(b.num_rows, object)
            short[mine] = Short.of(x).packed()
            short = pa.array(short, pa.binary())
            for s in range(0, len(at), 20_000):
                rows_at = pa.array(at[s : s + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[s : s + 20_000].astype(np.int32)), pa.array(side[s : s + 20_000].astype(np.int32)), pa.array(cells[at[s : s + 20_000]]), b.column("key").take(rows_at), short.take(rows_at)],
                    ["task", "side", "cell", "key", "short"],
                )


def _join(batches: Iterator[pa.RecordBatch], threshold: float, plans: list[tuple[int, Plan]]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (task, side): the rows of a task's block are held; those that visit it stream past them."""
    parts: list[tuple[Short, np.ndarray, np.ndarray]] = []
    held: _Held | None = None
    doubts: list[tuple[np.ndarray, np.ndarray]] = []
    at, same = None, False

    def links(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])

    def hold() -> _Held:
        found = _Held(Short.joined([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), threshold, next(p for end, p in plans if at < end))
        parts.clear()
        if same:
            doubts.append(found.within())
        return found

    def close() -> Iterator[pa.RecordBatch]:
        last = hold() if parts else held
        if last is not None:
            a, b = last.stars()
            yield links(a, b, np.ones(len(a), bool))
        for a, b in doubts:
            yield links(a, b, np.zeros(len(a), bool))
        doubts.clear()

    for batch in batches:
        where = batch.column("task").to_numpy().astype(np.int64) * 3 + batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(where)) + 1), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            piece = batch.slice(s, e - s)
            if where[s] // 3 != at:
                yield from close()
                at, same, held = where[s] // 3, where[s] % 3 == 0, None
            x, cells, keys = Short.unpacked(piece.column("short")), piece.column("cell").to_numpy().astype(np.int64), piece.column("key").to_numpy()
            if where[s] % 3 < 2:
                parts.append((x, cells, keys))
            elif parts or held:
                held = held or hold()
                yield links(*held.across(x, cells, keys))
    yield from close()


def _decide(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The doubtful pairs whose whole vectors, in double precision, reach the threshold."""
    for b in batches:
        if b.num_rows:
            hit = [float(np.dot(x, y)) >= threshold - 1e-7 for x, y in ((np.frombuffer(v, np.float32).astype(np.float64) for v in p) for p in zip(b.column("x").to_pylist(), b.column("y").to_pylist()))]
            yield b.select(["a", "b", "sure"]).filter(pa.array(hit, pa.bool_()))


def close_links(usable: DataFrame, threshold: float) -> DataFrame:
    """(a, b) keys of linked entries: enough links that entries are connected by them just as by all pairs of cosine >= ``threshold``.

    Exact. The entries of a model are cut into cells, as many as the square root of their number, around centers that begin with a k-center's entries
    (:class:`Centers`) and rows of a bounded sample and are moved to the middle of what the sample has near them; the cells are cut into blocks of equal
    size. Each entry is compared with its own block and visits, of each two blocks one way, those that may hold a partner; in a block, only cells that
    may. Two bounds say which: the plane between two centers, and the angle of a cell's farthest row. The more cells, the
    less is left: work grows slower than the square, but where vectors spread evenly over all directions. Pairs are first looked at by
    outlines of a quarter of the dimensions, whose product bounds the cosine from above. Vectors travel in sixteen bits a dimension
    with a bound of their error; the pairs that this can't tell are decided from whole vectors, in double. No pair list of a group is
    made: a set of connected rows leaves a block as one star, and a visitor as one link, besides pairs in doubt between sets.
    """
    spark = usable.sparkSession
    centers, counts = Centers(usable, CELLS), model_counts(usable)
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    rows = usable.select("model_name", F.xxhash64("id").alias("key"), "unit")
    samples = sampled(usable, counts, 23)
    units = {m: centers_of(samples.get(m, u), cells_for(counts[m]), u) for m, u in centers.units.items()}
    sizes, least = homes(usable, units)
    plans = {m: Plan(units[m], sizes[m], least[m], threshold) for m in counts}
    first, total, ends = {}, 0, []
    for m, p in plans.items():
        first[m], total = total, total + p.blocks * p.parts
        ends.append((total, p))
    placed = rows.mapInArrow(partial(_place, plans=plans, first=first), PLACED)
    found = written(placed.repartitionById(total, F.col("task")).sortWithinPartitions("task", "side").mapInArrow(partial(_join, threshold=threshold, plans=ends), LINK), "links")
    doubtful = found.where("not sure")
    if n := doubtful.count():
        few = F.broadcast if n <= FEW else lambda df: df  # few of them go to where the vectors are; many meet them by key
        first_side = rows.select(F.col("key").alias("a"), F.col("unit").alias("x")).join(few(doubtful), "a")
        both = rows.select(F.col("key").alias("b"), F.col("unit").alias("y")).join(few(first_side), "b").select("a", "b", "sure", "x", "y")
        found = found.where("sure").unionByName(both.mapInArrow(partial(_decide, threshold=threshold), LINK))
    return found.select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(root, key) for every key of ``links`` (a, b): the smallest key that it is connected with.

    Alternating large-star and small-star steps; each is a group-wise minimum and a join-free emit, and each round is written to the
    shared folder. Goes on until the edges are stars, which takes about the square of the logarithm of their number of rounds at most. A key with very many links is grouped by partial minima, never collected.
    """
    place = scratch(links.sparkSession, "edges")
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges", place)

    def star(e: DataFrame, both: bool) -> DataFrame:
        arcs = e.select(F.col("high").alias("u"), F.col("low").alias("v"))
        if both:
            arcs = arcs.unionByName(e.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = arcs.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")).select("m", F.col("v").alias("x")) if both else joined.where(F.col("v") != F.col("m")).select("m", F.col("v").alias("x")).unionByName(least.select("m", F.col("u").alias("x")))
        return moved.where("m <> x").select(F.least("m", "x").alias("low"), F.greatest("m", "x").alias("high")).distinct()

    while True:
        before, place = place, scratch(links.sparkSession, "edges")
        nxt = written(star(star(edges, True), False), "edges", place)
        drop_scratch(before)
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("high").alias("highs")).first()
        lows = nxt.select(F.col("low").alias("high")).distinct().join(nxt.select("high").distinct(), "high", "left_semi").limit(1).count()
        edges = nxt
        if lows == 0 and state["n"] == state["highs"]:  # every key hangs on one root, and no root hangs on another
            return edges.select(F.col("low").alias("root"), F.col("high").alias("key"))


def close_groups(usable: DataFrame, threshold: float) -> DataFrame:
    """(first_id, member_id): for each set of entries that are connected by cosines of at least ``threshold`` within one model,
    its smallest id with each other member. Entries without a link are in no row. A null threshold, or one beyond [-1, 1], gives no rows."""
    spark = usable.sparkSession
    if threshold is None or not -1 <= threshold <= 1:
        return spark.createDataFrame([], "first_id string, member_id string")
    found = components(close_links(usable, threshold))
    names = usable.select(F.xxhash64("id").alias("key"), "id")
    members = written(found.select("root", "key").unionByName(found.select("root", F.col("root").alias("key")).distinct()).join(names, "key").select("root", "id"), "members")
    firsts = members.groupBy("root").agg(F.min("id").alias("first_id"))
    return members.join(firsts, "root").where("id <> first_id").select("first_id", F.col("id").alias("member_id"))
