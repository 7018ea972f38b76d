"""The embedding hook: any function from texts to vectors, run in Arrow batches; and a deterministic one for tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.caches import split_hits

MAX_TEXT_BYTES = 8192


def hash_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic unit vectors from hashed words; similar texts share words, so they lie nearer."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % dimensions] += 1 if h[4] & 1 else -1
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1)

    return embed


def batch_size(priority: str = "normal", load: float = 0.4, waiting: int = 0, most: int = 100) -> int:
    """Texts for one call of the model: 5 where someone waits (high), 10, or 20 in the background (low); half of it under a load above 0.8, twice
    as many below 0.3 or with more than 100 texts waiting; at least 1, at most ``most``."""
    base = {"high": 5, "normal": 10, "low": 20}[priority]
    factor = 0.5 if load > 0.8 else 2.0 if load < 0.3 or waiting > 100 else 1.0
    return max(1, min(most, int(base * factor)))


def _called(model: Callable[[list[str]], np.ndarray], texts: list[str], waits: tuple[float, ...]) -> np.ndarray:
    """The model's answer, asked again after each of ``waits`` seconds; the last failure is raised."""
    for wait in (*waits, None):
        try:
            return model(texts)
        except Exception:
            if wait is None:
                raise
            time.sleep(wait)
    raise AssertionError


def embed(text: Column, model: Callable[[list[str]], np.ndarray], batch: int = 10, prepare: Callable[[str], str] | None = None, waits: tuple[float, ...] = (1.0, 2.0, 4.0), strict: bool = True) -> Column:
    """Vectors of a text column; null for null and blank texts and those over 8192 bytes. The model gets ``batch`` texts at a time.

    ``prepare`` cleans a text before it is sent. A call that fails is made again after ``waits`` seconds; a batch that keeps failing is sent text by text. A text
    that keeps failing alone fails the job, or (``strict`` False) has a null vector.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            good = s.map(lambda t: t is not None and bool(t.strip()) and len(t.encode()) <= MAX_TEXT_BYTES)
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            at = s.index[good]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                texts = [prepare(t) if prepare else t for t in s[part]]
                try:
                    found = list(_called(model, texts, waits))
                except Exception:
                    found = []
                    for t in texts:
                        try:
                            found.append(_called(model, [t], waits)[0])
                        except Exception:
                            if strict:
                                raise
                            found.append(None)
                for i, v in zip(part, found):
                    out[i] = None if v is None else [float(x) for x in v]
            yield out

    return run(text)


def embed_with_cache(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """Vectors from the cache (key, vector) where there are any, from the model otherwise; ``key`` is the text's SHA-256. Equal texts are embedded once."""
    keyed = requests.withColumn("key", F.sha2(text, 256))
    hits, misses = split_hits(keyed, cache, "key")
    fresh = misses.where(F.col("key").isNotNull()).select("key", F.col(text).alias("_t")).dropDuplicates(["key"]).select("key", embed(F.col("_t"), model).alias("vector"))
    return hits.unionByName(misses.join(fresh, "key", "left"))
