"""Path expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))


@F.arrow_udf(StringType())
def _nfc(path: pa.Array) -> pa.Array:
    """Composed form. Arrow's own kernel leaves combining marks apart (measured on the installed version), so the standard library composes."""
    if pc.all(pc.string_is_ascii(path)).as_py() is not False:
        return path
    return pa.array([p if p is None or p.isascii() else unicodedata.normalize("NFC", p) for p in path.to_pylist()], pa.string())


def plain_path(path: Column) -> Column:
    """Plain form: ``/`` separates, no empty and no ``.`` segments, Unicode NFC, letter case kept; null stays null.

    Only the composition leaves the JVM, in Arrow batches; batches of ASCII pass through untouched.
    """
    return _nfc(F.array_join(_segments(path), "/"))


def plain_path_py(path: str | None) -> str | None:
    """The same on the driver, for parameters."""
    if path is None:
        return None
    return unicodedata.normalize("NFC", "/".join(s for s in path.replace("\\", "/").split("/") if s not in ("", ".")))


def normalize_separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    """Text after the last separator."""
    return F.regexp_extract(normalize_separators(path), r"([^/]*)$", 1)


def parent_path(path: Column) -> Column:
    """Text before the last separator; empty at the top."""
    return F.regexp_extract(normalize_separators(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def depth(path: Column) -> Column:
    return F.size(_segments(path)) - 1
