"""Chunkers: fixed, semantic, hybrid and markdown-aware, by characters; and the plain character chunker."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.markdown import elements, heading_paths

CHUNK = (
    "doc_id string, chunk_index int, total_chunks int, content string, start_position int, end_position int, character_count int, word_count int, sentence_count int, "
    "has_previous_overlap boolean, has_next_overlap boolean, previous_overlap_size int, next_overlap_size int, heading_path array<string>, element_kinds map<string,int>"
)


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "semantic"
    max_size: int = 1000
    overlap: int = 100
    min_size: int = 100
    strip: bool = False

    def check(self) -> ChunkConfig:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if not 200 <= self.max_size <= 2000 or self.overlap > self.max_size // 2 or self.overlap < 0 or not 0 <= self.min_size < self.max_size:
            raise ValueError("200 <= max_size <= 2000, 0 <= overlap <= max_size / 2 and min_size < max_size must hold")
        return self


class Boundaries:
    """Boundary positions of a whole text, found once; windows are looked up by bisection."""

    _END = re.compile(r"[.!?]")
    _STOP = re.compile(r"[.!?…]")

    def __init__(self, text: str):
        self.text = text
        self.paragraphs = [m.start() + 2 for m in re.finditer(r"(?=\n\n)", text)]
        self.marks = [m.start() for m in self._END.finditer(text)]
        self.after = [self._skip(i + 1) for i in self.marks]
        self.blocks = sorted({*self.paragraphs_strict("\n\n"), *self.paragraphs_strict("\r\n\r\n")})
        self.stops = [m.start() for m in self._STOP.finditer(text)]

    def _skip(self, i: int) -> int:
        while i < len(self.text) and self.text[i] == " ":
            i += 1
        return i

    def paragraphs_strict(self, mark: str) -> list[int]:
        return [m.end() for m in re.finditer(re.escape(mark), self.text)]

    @staticmethod
    def _nearest(options: list[int], target: int) -> int | None:
        return min(options, key=lambda p: abs(target - p), default=None)

    def best(self, target: int, reach: int) -> int:
        """Nearest paragraph break within reach, else sentence end, else the word boundary before (or after) the target."""
        n = len(self.text)
        if target >= n:
            return n
        lo, hi = max(0, target - reach), min(n, target + reach)
        p = self.paragraphs[bisect_left(self.paragraphs, lo + 2) : bisect_right(self.paragraphs, hi)]
        if p:
            return self._nearest(p, target)
        at = range(bisect_left(self.marks, lo), bisect_left(self.marks, hi))
        s = [self.after[k] for k in at if self.after[k] < hi]
        if s:
            return self._nearest(s, target)
        for i in range(target - 1, lo - 1, -1):
            if self.text[i] in " \t\n\r\f":
                return i + 1
        return next((i for i in range(target, hi) if self.text[i] in " \t\n\r\f"), target)

    def nearest_any(self, target: int, reach: int) -> int:
        """Nearest of sentence ends (before white space) and paragraph breaks within reach, else the target."""
        n = len(self.text)
        if target >= n:
            return n
        lo, hi = max(0, target - reach), min(n, target + reach)
        found = {p for p in self.blocks if lo + 2 <= p <= hi}
        for i in self.stops[bisect_left(self.stops, lo) : bisect_left(self.stops, hi)]:
            e = i + 1
            if e >= hi or self.text[e].isspace() or e == hi - 1:
                found.add(e)
        return self._nearest(sorted(found), target) if found else target


def _fixed(text: str, c: ChunkConfig) -> list[tuple[int, int]]:
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + c.max_size, n)
        out.append((at, end))
        if end >= n:
            break
        at = end - c.overlap
    return out


def _forward(at: int, end: int, overlap: int) -> int:
    """Next start: back by the overlap, but always further than the last start."""
    return max(at + 1, min(end, max(end - overlap, 0)))


def _semantic(text: str, c: ChunkConfig) -> list[tuple[int, int]]:
    b, out, at, n = Boundaries(text), [], 0, len(text)
    while at < n:
        target = min(at + c.max_size, n)
        if target >= n or n - at <= c.min_size:
            if text[at:].strip():
                out.append((at, n))
            break
        end = max(b.best(target, c.max_size // 4), at + 1)
        if text[at:end].strip() and end - at >= c.min_size:
            out.append((at, end))
        at = _forward(at, end, c.overlap)
    return out


def _hybrid(text: str, c: ChunkConfig) -> list[tuple[int, int]]:
    b, out, at, n = Boundaries(text), [], 0, len(text)
    while at < n:
        target = min(at + c.max_size, n)
        end = b.best(target, c.max_size // 3)
        if end < at + c.min_size:
            end = target
        if text[at:end].strip():
            out.append((at, end))
        if end >= n:
            break
        at = _forward(at, end, c.overlap)
    return out


def _markdown(text: str, c: ChunkConfig) -> list[tuple[int, int]]:
    b, found = Boundaries(text), elements(text)
    heads = sorted(e["start"] for e in found if e["kind"] == "header")
    code = sorted((e["start"], e["end"]) for e in found if e["kind"] == "code")
    starts = [s for s, _ in code]
    out, at, n, reach = [], 0, len(text), c.max_size // 4
    while at < n:
        target = min(at + c.max_size, n)
        k = bisect_right(starts, at) - 1
        block = code[k] if k >= 0 and at < code[k][1] else None
        if block:
            end = min(block[1], n)
        elif target >= n:
            end = n
        else:
            near = [h for h in heads[bisect_left(heads, target - reach) : bisect_right(heads, min(n, target + reach))] if h > at]
            end = Boundaries._nearest(near, target) if near else b.nearest_any(target, reach)
        end = max(end, at + 1)
        if (text[at:end].strip() and end - at >= c.min_size) or end >= n:
            out.append((at, end))
        if end >= n:
            break
        at = end if block else _forward(at, end, c.overlap)
    return out


STRATEGIES = {"fixed_size": _fixed, "semantic": _semantic, "hybrid": _hybrid, "markdown_aware": _markdown}
_WORD, _SENTENCE = re.compile(r"[^ \t\n\r\f]+"), re.compile(r"[.!?]+")


def chunks_of(text: str, config: ChunkConfig) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; none for an empty one."""
    return STRATEGIES[config.strategy](text, config) if text else []


def _plain(text: str) -> str:
    out = re.sub(r"#{1,6} ", "", text).translate(str.maketrans("", "", "*_`"))
    return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", out)


def _chunk(batches: Iterator[pd.DataFrame], config: ChunkConfig) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CHUNK.split(", ")]
    for pdf in batches:
        rows: list[tuple] = []
        for key, text in zip(pdf["doc_id"], pdf["text"]):
            if not text:
                continue
            parts = chunks_of(text, config)
            found = sorted(elements(text), key=lambda x: x["start"]) if config.strategy == "markdown_aware" else []
            begins, paths = [x["start"] for x in found], heading_paths(found, [s for s, _ in parts])
            for i, (s, e) in enumerate(parts):
                body = text[s:e]
                kinds: dict[str, int] = {}
                for x in found[bisect_left(begins, s) : bisect_left(begins, e)]:
                    kinds[x["kind"]] = kinds.get(x["kind"], 0) + 1
                path = paths[i]
                more, before = e < len(text), i > 0
                rows.append((key, i, len(parts), _plain(body) if config.strip else body, s, e, len(body), len(_WORD.findall(body)), max(1, len(_SENTENCE.findall(body))), before, more,
                             config.overlap if before else 0, config.overlap if more else 0, path, kinds))
        yield pd.DataFrame(rows, columns=names)


def chunk(docs: DataFrame, config: ChunkConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All chunks of all texts with their metadata. Null and empty texts have none. Per row, whole texts, no shuffle.

    Semantic and hybrid chunks may exceed the maximum by the search range (a quarter, a third). Overlap sizes are nominal. With the markdown
    strategy a chunk also knows the headings it is under and what elements begin in it.
    """
    config.check()
    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(partial(_chunk, config=config), CHUNK)


def windows(text: Column, size: int, overlap: int, least: int = 20) -> Column:
    """array<string> of trimmed windows of ``size`` characters, each beginning ``size - overlap`` after the last, of at least ``least`` characters; a text
    that gives none is one chunk. In generated code."""
    if not 20 <= size <= 8192 or not 0 <= overlap < size:
        raise ValueError("20 <= size <= 8192 and 0 <= overlap < size must hold")
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size))))
    kept = F.filter(cut, lambda c: F.length(c) >= least)
    return F.when(n <= size, F.array(text)).when(F.size(kept) > 0, kept).when(F.length(F.trim(text)) > 0, F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))


#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr",
    "vs", "etc", "i.e", "e.g", "cf", "al", "Inc", "Ltd", "Corp",
    "A.M", "P.M", "a.m", "p.m", "AM", "PM",
    "U.S", "U.K", "E.U", "NASA", "FBI", "CIA",
)
_SENTENCE_END, _PARAGRAPH = re.compile(r"[.!?]+\s+"), re.compile(r"\n\s*\n")
_SHORT = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")$", re.I)


def adjusted(text: str, size: int, overlap: int, least: int = 20, sentences: bool = True, paragraphs: bool = True) -> list[str]:
    """Windows of at most ``size`` characters that end where the last sentence in them ends (but for abbreviations), or rather where the last blank line
    in what is then left begins; trimmed, of at least ``least`` characters. The next one begins ``overlap`` before the end, or at
    the end of a window that is no longer than that. A text within the size is one window as it is; one that gives none is one trimmed window."""
    if len(text) <= size:
        return [text] if text else []
    out, at, n = [], 0, len(text)
    ends = [m.end() for m in _SENTENCE_END.finditer(text) if not _SHORT.search(text, max(0, m.start() - 8), m.start())] if sentences else []
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)] if paragraphs else []
    while at < n:
        end = min(at + size, n)
        for places in (ends, breaks) if end < n else ():
            k = bisect_right(places, end) - 1
            if k >= 0 and places[k] > at:
                end = places[k]
        piece = text[at:end].strip()
        if len(piece) >= max(1, least):
            out.append(piece)
        if end >= n:
            break
        at = end - overlap if end - overlap > at else end
    return out or ([text.strip()] if text.strip() else [])


def adjusted_windows(text: Column, size: int, overlap: int, least: int = 20, sentences: bool = True, paragraphs: bool = True) -> Column:
    """array<string> of :func:`adjusted` windows, in Arrow batches; null texts have null."""
    if not 20 <= size <= 8192 or not 0 <= overlap < size:
        raise ValueError("20 <= size <= 8192 and 0 <= overlap < size must hold")

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else adjusted(t, size, overlap, least, sentences, paragraphs) for t in column.to_pylist()], pa.list_(pa.string()))

    return run(text)


def size_benchmark(docs: DataFrame, sizes: list[int], text: str = "text") -> DataFrame:
    """Chunks, mean length and total characters per window size (no overlap)."""
    rows = docs.where(F.length(text) > 0).select(F.explode(F.array(*[F.struct(F.lit(s).alias("size"), windows(F.col(text), s, 0).alias("chunks")) for s in sizes])).alias("r"))
    each = rows.select("r.size", F.explode("r.chunks").alias("chunk"))
    return each.groupBy("size").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_length"), F.sum(F.length("chunk")).alias("characters"))
