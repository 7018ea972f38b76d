"""References without a list of pairs: the greedy order at any size, and what is written on the way."""

from pathlib import Path

import numpy as np
import pytest

from notelake.operators import compression, references
from notelake.session import shared_folder


def greedy(ids, x, threshold):
    """(member: seed) by all pairs, in id order."""
    order = np.argsort(np.array(ids, object))
    u = x[order].astype(np.float64)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    s = u @ u.T
    taken = np.zeros(len(u), bool)
    for i in range(len(u)):
        if not taken[i]:
            taken[i + 1 :] |= s[i, i + 1 :] >= threshold
    seeds, names = np.flatnonzero(~taken), [ids[i] for i in order]
    return {names[i]: names[seeds[s[i, seeds].argmax()]] for i in np.flatnonzero(taken)}


def vectors(kinds, rows, width, apart, seed=5):
    """Vectors around ``kinds`` directions, of all lengths, half of them alone."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, width))
    grouped = r.random(rows) < 0.5
    x[grouped] = r.normal(size=(kinds, width))[r.integers(0, kinds, grouped.sum())] + apart * r.normal(size=(grouped.sum(), width))
    return [f"é{i:05d}" for i in r.permutation(rows)], (x * 2.0 ** r.integers(-3, 5, rows)[:, None]).astype(np.float32)


@pytest.mark.parametrize("apart", [0.02, 0.3])
def test_rounds_and_blocks_keep_the_greedy_order(spark, monkeypatch, apart):
    ids, x = vectors(12, 1500, 16, apart)
    rows = [(i, [float(y) for y in v]) for i, v in zip(ids, x)] + [("none", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(5)
    want = greedy(ids, x, 0.9)
    assert {r.id: r.reference for r in references.best_references(df, 0.9).collect()} == want
    monkeypatch.setattr(references, "FEW_ROWS", 20)
    monkeypatch.setattr(references, "LEAST_ROWS", 100)
    monkeypatch.setattr(references, "BLOCK_BYTES", 1)
    found = {r.id: (r.reference, r.similarity) for r in references.best_references(df, 0.9).collect()}
    assert {k: v[0] for k, v in found.items()} == want
    assert all(0.9 <= v[1] <= 1 for v in found.values())


def test_a_large_group_of_close_vectors_writes_no_pairs(spark):
    written = lambda: {p: p.stat().st_size for p in Path(shared_folder(spark)).rglob("*.parquet")}
    r = np.random.default_rng(2)
    x = (r.normal(size=64) + 0.01 * r.normal(size=(1500, 64))).astype(np.float32)
    df = spark.createDataFrame([(str(i), [float(y) for y in v]) for i, v in enumerate(x)], "id string, vector array<float>")
    before = written()
    held, shared = compression.pool_encoded(df, 0.9)
    assert sum(n for p, n in written().items() if p not in before) <= 2 * x.nbytes  # the pool itself; of 1.1 million pairs nothing
    back = compression.pool_decoded(held, shared).collect()
    assert len(back) == 1500 and max(np.abs(np.array(b.vector) - x[int(b.id)]).max() for b in back) < 0.001
    assert {b.kind: b["count"] for b in shared.groupBy("kind").count().collect()} == {"raw": 1, "delta": 1499}
