"""Vector kernels: native expressions over array<float>, and the NumPy forms that Arrow operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single-precision machine epsilon.
F32_EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if either side is null or the lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in [-1, 1]. Null where it is undefined: null or empty, lengths differ, an element not finite, a norm of 0."""
    bottom = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    raw = dot(a, b) / bottom
    return F.when((bottom > 0) & (bottom < float("inf")) & raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def storage_cosine(a: Column, b: Column) -> Column:
    """The storage variant: 0 where :func:`cosine` is undefined."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def cosine_normalized(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clamped."""
    raw = dot(a, b)
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def normalize(a: Column) -> Column:
    """Unit vector in double; null for a zero, empty or non-finite vector."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_zero(a: Column) -> Column:
    """Empty or all zero."""
    return (F.size(a) == 0) | F.forall(a, lambda x: x == 0)


def almost_equal(a: Column, b: Column) -> Column:
    """Same length and no element apart by the single-precision epsilon or more."""
    return F.when(F.size(a) == F.size(b), F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < F32_EPSILON)).otherwise(F.lit(False))


def dimension(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def vector_hash(a: Column) -> Column:
    """SHA-256 of the vector's elements (as JSON numbers, so equal vectors have equal hashes)."""
    return F.sha2(F.to_json(a), 256)


def unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit rows as float32) of the list array's usable vectors: ``width`` elements, all finite, not all zero."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    if not len(at) or not width:
        return np.empty(0, np.int64), np.empty((0, width), np.float32)
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    rows = flat.astype(np.float64).reshape(len(at), width)
    with np.errstate(all="ignore"):
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        rows, at = rows[good], at[good]
        rows /= top[good][:, None]
        rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return at, rows.astype(np.float32)
