"""Current, usable embedding entries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.paths import plain_path
from notelake.functions.vectors import unit_rows

#: Dimensions of the models in use.
MODEL_DIMENSIONS = {"quill-embed-s": 128, "quill-embed-xs": 64}

UNIT = "id string, updated_at long, model_name string, file_path string, unit binary"


def _units(batches: Iterator[pa.RecordBatch], dimensions: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        models, vectors = b.column("model_name").to_pylist(), b.column("vector")
        unit: list[bytes | None] = [None] * b.num_rows
        for model, width in dimensions.items():
            mine = np.flatnonzero(np.array([m == model for m in models], bool))
            at, rows = unit_rows(vectors.take(pa.array(mine)), width)
            for i, row in zip(mine[at], rows):
                unit[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "updated_at", "model_name", "file_path")] + [pa.array(unit, pa.binary())], ["id", "updated_at", "model_name", "file_path", "unit"])


def usable_entries(entries: DataFrame, dimensions: dict[str, int] | None = None) -> DataFrame:
    """(id, model_name, file_path, unit): the current row of each id, if its vector can be compared.

    Current is the greatest ``updated_at`` (null first; ties: the greatest model, path, vector). Usable is a vector with exactly
    the model's dimensions, all finite, not all zero; ``unit`` holds it at unit length as little-endian float32. Paths are
    in plain form, null stays null. Null ids are no entries. One shuffle, by id, carries each vector once.
    """
    packed = entries.select("id", F.col("updated_at").cast("long"), "model_name", "file_path", "vector").where(F.col("id").isNotNull())
    units = packed.mapInArrow(partial(_units, dimensions=dimensions or MODEL_DIMENSIONS), UNIT)
    latest = units.groupBy("id").agg(F.max(F.struct("updated_at", "model_name", "file_path", "unit")).alias("r"))
    return latest.where(F.col("r.unit").isNotNull()).select("id", F.col("r.model_name").alias("model_name"), plain_path(F.col("r.file_path")).alias("file_path"), F.col("r.unit").alias("unit"))
