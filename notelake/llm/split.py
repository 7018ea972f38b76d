"""Splitting oversized texts at natural boundaries by dynamic programming over boundary positions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a cut by what precedes it; between, a cut costs as the best boundary at its place.
BREAKS = [
    (0.0, regex.compile(r"\n[ \t\r]*\n\s*")),  # paragraph
    (0.05, regex.compile(r"\n(?=[ \t]{0,3}#{1,6}\s)")),  # before a heading
    (0.15, regex.compile(r"\r\n?|\n")),  # line
    (0.3, regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*")),  # sentence
    (0.6, regex.compile(r"[,;:]\s+|[、，；：]")),  # clause
    (1.0, regex.compile(r"\s+")),  # word
]
ANYWHERE, FENCED = 4.0, 0.5
FENCE = regex.compile(r"^[ \t]{0,3}(```|~~~)", regex.M)

PIECES = "chunk_key long, piece int, pieces int, start int, end int, overlap int, text string"


def _boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut is thought of, and the cost of each: every boundary of every kind, and steps between signs where there is none for long."""
    n = len(text)
    cost: dict[int, float] = {}
    for price, pattern in BREAKS:
        for m in pattern.finditer(text):
            if 0 < m.end() < n:
                cost.setdefault(m.end(), price)
    at = np.array(sorted([0, n, *cost]))
    step = max(1, reach // 8)
    for a, b in [(int(a), int(b)) for a, b in zip(at, at[1:]) if b - a > reach // 2]:  # no natural boundary for long: between characters
        for p in range(a + step, b, step):
            cost.setdefault(_between(text, p, a, reach), ANYWHERE)
    fences = [m.start() for m in FENCE.finditer(text)]
    at = np.array(sorted(cost), dtype=np.int64)
    price = np.array([cost[int(p)] for p in at])
    if fences and len(at):
        price = price + FENCED * ((np.searchsorted(np.array(fences), at, side="left") % 2) == 1)
    return at, price


def _joined(text: str, p: int) -> bool:
    """Whether the characters around position ``p`` belong to one visible sign."""
    a, b = text[p - 1], text[p]
    if a == "‍" or b == "‍" or b in "︎️⃣" or unicodedata.combining(b) or "\U0001f3fb" <= b <= "\U0001f3ff" or (a == "\r" and b == "\n"):
        return True
    if "\U0001f1e6" <= a <= "\U0001f1ff" and "\U0001f1e6" <= b <= "\U0001f1ff":  # flags are pairs
        k = p - 1
        while k > 0 and "\U0001f1e6" <= text[k - 1] <= "\U0001f1ff":
            k -= 1
        return (p - k) % 2 == 1
    return "\U000e0020" <= b <= "\U000e007f"


def _between(text: str, p: int, a: int, reach: int) -> int:
    """The last place between signs at or before ``p``, after ``a`` and not too far back; ``p`` if there is none."""
    q, back = p, max(1, min(32, reach // 3))
    while q > a + 1 and p - q < back and _joined(text, q):
        q -= 1
    return p if _joined(text, q) else q


def cuts(text: str, size: int, overlap: int) -> list[int]:
    """Cut positions (the end of each piece but the last), cheapest by boundary costs plus squared imbalance, over all boundary positions.

    Piece 1 is text[0:c1], piece i is text[c(i-1)-overlap:ci]; none is longer than ``size``. ``overlap`` is cut to size - 1.
    """
    n, overlap = len(text), max(0, min(overlap, size - 1))
    if n <= size:
        return []
    reach = size - overlap  # what a piece adds
    number = 1 + -(-(n - size) // reach)
    ideal = (n - overlap) / number  # what each piece adds when all are alike
    at, price = _boundaries(text, reach)
    at = np.concatenate(([0], at, [n]))
    price = np.concatenate(([0.0], price, [0.0]))
    best, back = np.full(len(at), np.inf), [-1] * len(at)
    best[0] = 0.0
    begin, place, prices = np.searchsorted(at, at - reach, side="left").tolist(), at.tolist(), price.tolist()
    scaled, room = at / reach, np.empty(len(at))
    for j in range(1, len(at)):
        i0, here = begin[j], (place[j] - ideal) / reach
        # the first piece may be longer, as nothing overlaps it
        head = ((place[j] - overlap - ideal) / reach) ** 2 if place[j] <= size else np.inf
        low, at_low = head, 0
        first = max(i0, 1)
        if first < j:
            total = room[: j - first]
            np.subtract(here, scaled[first:j], out=total)
            np.multiply(total, total, out=total)
            np.add(total, best[first:j], out=total)
            k = int(total.argmin())
            if total[k] <= head:
                low, at_low = float(total[k]), first + k
        if low < np.inf:
            best[j], back[j] = low + prices[j], at_low
    if not np.isfinite(best[-1]):  # boundaries too far apart (long signs moved the steps): as far as each piece may reach
        ends = [_between(text, size, 0, reach)]
        while n - ends[-1] > reach:
            ends.append(_between(text, ends[-1] + reach, ends[-1], reach))
        return ends
    out, j = [], int(back[-1])
    while j > 0:
        out.append(int(at[j]))
        j = int(back[j])
    return out[::-1]


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    ends = [*cuts(text, size, overlap), len(text)]
    overlap = max(0, min(overlap, size - 1))
    return [(0 if k == 0 else max(0, ends[k - 1] - overlap), e) for k, e in enumerate(ends)]


_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), _TYPES)], names)

    for b in batches:
        rows: list[tuple] = []
        for key, text, size, overlap in zip(*(b.column(c).to_pylist() for c in ("chunk_key", "content", "max_chunk_size", "overlap_size"))):
            if text is None or size is None or size < 1:
                rows.append((key, 0, 1, 0, len(text or ""), 0, text))
                continue
            parts = pieces(text, size, overlap or 0)
            for k, (a, e) in enumerate(parts):
                rows.append((key, k, len(parts), a, e, parts[k - 1][1] - a if k else 0, text[a:e]))
            if len(rows) >= 5000:
                yield batch(rows)
                rows = []
        yield batch(rows)


def _configured(configs: DataFrame) -> DataFrame:
    """One row per configuration; of a repeated one the greatest sizes."""
    return configs.groupBy("config_id").agg(F.max(F.struct("max_chunk_size", "overlap_size")).alias("c")).select("config_id", "c.*")


def split(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """(chunk_key, piece, pieces, start, end, overlap, text) of every chunk; positions are in code points.

    A chunk within its maximum is one piece; so is a null content (null text) and a chunk whose configuration is
    unknown or has no positive maximum. Where a window has no natural boundary, cuts fall between visible signs;
    a sign longer than a piece may be cut. Repeated chunks are split each; of a repeated configuration the greatest sizes hold. Work is per row; the text is never cut short.
    """
    config = _configured(configs)
    rows = chunks.select(F.col("chunk_key").cast("long").alias("chunk_key"), "content", "config_id").join(config, "config_id", "left").select("chunk_key", "content", "max_chunk_size", "overlap_size")
    return rows.mapInArrow(_split, PIECES)


def oversized(split_rows: DataFrame) -> DataFrame:
    return split_rows.where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("chunk_key")


def rejoined(split_rows: DataFrame, chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """(chunk_key, text, within, overlapping): pieces of each chunk put together without their overlaps, whether none is longer than the maximum, and whether each but the first
    begins with as much of the one before as is configured (all of what is before it, at most). Chunk keys must be unique. A group is the pieces of one text."""
    order = F.sort_array(F.collect_list(F.struct("piece", F.expr("substring(text, overlap + 1)").alias("t"))))
    known = chunks.select("chunk_key", "config_id").join(_configured(configs), "config_id", "left").select("chunk_key", "max_chunk_size", "overlap_size")
    used = F.greatest(F.lit(0), F.least(F.col("overlap_size"), F.col("max_chunk_size") - 1))
    rows = split_rows.join(known, "chunk_key")
    within = F.coalesce(F.length("text") <= F.col("max_chunk_size"), F.lit(True))
    overlapping = F.coalesce((F.col("piece") == 0) | (F.col("overlap") == F.least(used, F.col("start") + F.col("overlap"))), F.lit(True))
    return rows.groupBy("chunk_key").agg(order.alias("p"), F.count("text").alias("n"), F.min(within).alias("within"), F.min(overlapping).alias("overlapping")).select(
        "chunk_key", F.when(F.col("n") > 0, F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("text"), "within", "overlapping")
