"""Abusive, hateful or sexual content: a character n-gram linear classifier on naive-Bayes log-count ratios.

A note is a bag of passages (sentences, lines); it is a case if one of them is. Labels are per note, so the passage that
earns a positive label is found in rounds: the likeliest passage of each positive note, against the passages of negative notes, the
hardest of which are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.mixing import plain_source

#: Labelled notes that are used for fitting, at most, of the positive and of the negative class; the longest note among them and all of a class together, in characters.
LABELLED, LABELLED_CHARS, CLASS_CHARS = {1: 1_500, 0: 3_000}, 60_000, 12_000_000
#: Orders of the n-grams, bits of their hashed index.
ORDERS, BITS = (2, 3, 4, 5), 19
#: Share of negative notes that may be labelled wrongly; no more are left out.
WRONG = 0.03
#: Characters after which a passage without an end is cut.
LONG = 300
#: Added to the counts of the log-count ratios.
SMOOTH = 0.5
#: Characters that are worked on at once; longer notes are cut, between lines where there are any, with an overlap.
SLICE, OVERLAP = 400_000, 400

#: Signs written for other letters. Cyrillic and Greek twins of Latin letters, then digits and symbols inside words.
TWINS = dict(zip("аеорсухіјѕһԁԛԝвмнткαορνικτυχ", "aeopcyxijshdqwbmhtkaopviktux"))
LEET = dict(zip("0134578@$|", "oieastbasi"))

SCORED = "doc_id long, source string, score double, flagged boolean"
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,40}>")


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """For each code point of the basic plane the one it is read as; 0 for signs without width. Made by rule from Unicode data."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000 or 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7B0:
            continue
        s = chr(c)
        if unicodedata.category(s) in ("Cf", "Mn", "Me") and not 0x3099 <= c <= 0x309C:
            out[c] = 0
            continue
        base = unicodedata.normalize("NFKD", s)[:1].lower()[:1] or s
        if 0x3040 <= c < 0x3100:
            base = s
        out[c] = ord(base) if ord(base) < 0x10000 else c
    for a, b in TWINS.items():
        out[ord(a)] = ord(b)
        if len(a.upper()) == 1:
            out[ord(a.upper())] = ord(b)
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = c + 32
    for s in "*_`~^":
        out[ord(s)] = 0
    out[ord("\r")], out[ord("\t")] = ord(" "), ord(" ")
    return out


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 letter, 2 digit or symbol that may stand for a letter, 0 neither; by code point as read."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = 1
    for s in "0123456789@$|":
        out[ord(s)] = 2
    return out


@lru_cache(maxsize=1)
def _leet() -> np.ndarray:
    out = np.arange(0x80, dtype=np.uint32)
    for a, b in LEET.items():
        out[ord(a)] = ord(b)
    return out


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points as read, passage number of each, note number of each passage) of some notes."""
    cleaned = [_TAG.sub("", t) if "<" in t else t for t in texts]
    raw = np.frombuffer("\n".join(cleaned).encode("utf-32-le", "replace"), np.uint32)
    if not len(raw):
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.array([len(t) + 1 for t in cleaned])
    note = np.repeat(np.arange(len(cleaned)), lengths)[: len(raw)]
    small = np.minimum(raw, 0xFFFF)
    code = np.where(raw < 0x10000, _table()[small], raw)
    after = np.append(code[1:], 10)
    stop = (code == 46) | (code == 33) | (code == 63)
    ends = (code == 10) | (stop & ((after == 32) | (after == 10))) | (code == 0x3002)
    begins = np.append(True, ends[:-1])
    # a passage that doesn't end goes on as another one: at the first space after LONG characters, without spaces after four times as many
    offset = np.arange(len(code)) - np.maximum.accumulate(np.where(begins, np.arange(len(code)), 0))
    if offset.max() >= LONG:
        space = np.flatnonzero(code == 32)
        part = offset[space] // LONG
        fresh = np.append(True, (part[1:] != part[:-1]) & (offset[space][1:] > offset[space][:-1])) if len(space) else np.empty(0, bool)
        begins = begins | ((offset > 0) & (offset % (4 * LONG) == 0))
        begins[space[fresh & (part > 0)]] = True
    keep = code != 0
    kind = _kinds()[np.minimum(code, 0xFFFF)]
    # a hyphen or dot between letters is read over
    before = np.append(np.uint8(0), kind[:-1])
    follow = np.append(kind[1:], np.uint8(0))
    keep &= ~(((code == 45) | (code == 46)) & (before > 0) & (follow > 0))
    passage = np.cumsum(begins) - 1
    notes = note[begins]
    code, passage, kind = code[keep], passage[keep], kind[keep]
    if not len(code):
        return code, passage, notes
    # words: runs of letters and signs that may stand for letters
    inside = kind > 0
    starts = inside & ~np.append(False, inside[:-1])
    word = np.cumsum(starts) * inside
    count = int(word.max()) + 1
    letters = np.bincount(word, kind == 1, count) > 0
    size = np.bincount(word, minlength=count)
    digit = kind == 2
    mixed = digit & letters[word] & (word > 0)
    code[mixed] = _leet()[np.minimum(code[mixed], 0x7F)]
    code[digit & ~mixed & (code != 64) & (code != 36) & (code != 124)] = 48
    # single letters set apart are read together
    single = (size == 1) & letters
    left = np.maximum.accumulate(word)
    gap = (word == 0) & (code != 10) & (left > 0) & (left + 1 < count)
    drop = gap & single[left] & single[np.minimum(left + 1, count - 1)]
    if drop.any():
        code, passage = code[~drop], passage[~drop]
    return code, passage, notes


def grams(code: np.ndarray, passage: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed index of the n-gram that begins at each position, and whether it lies within one passage."""
    h = code.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in ORDERS:
            yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64), passage[: len(code) - n + 1] == passage[n - 1 :]


class Model:
    """Linear weights over hashed n-grams (ratios already multiplied in), applied to passages scaled by their length."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float):
        self.weights, self.bias, self.threshold = weights.astype(np.float32), bias, threshold

    def passages(self, code: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
        total, size = np.zeros(count), np.zeros(count)
        for index, whole in grams(code, passage):
            w = np.where(whole, self.weights[index], np.float32(0))
            total += np.bincount(passage[: len(w)], w, count)
            size += np.bincount(passage[: len(w)], whole, count)
        return total / np.sqrt(np.maximum(size, 1)) + self.bias

    def notes(self, texts: list[str | None]) -> np.ndarray:
        """The score of each note's highest passage; a null or blank note scores -inf."""
        out = np.full(len(texts), -np.inf)
        todo: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            for piece in slices(t or ""):
                todo.append((i, piece))
        s = 0
        while s < len(todo):
            e, chars = s, 0
            while e < len(todo) and (e == s or chars + len(todo[e][1]) <= SLICE):
                chars += len(todo[e][1])
                e += 1
            code, passage, notes = read([t for _, t in todo[s:e]])
            if len(notes):
                found = self.passages(code, passage, len(notes))
                busy = np.bincount(passage, minlength=len(notes)) > 2
                np.maximum.at(out, np.array([i for i, _ in todo[s:e]])[notes[busy]], found[busy])
            s = e
        return out


def slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            line = text.rfind("\n", at + SLICE // 2, end)
            end = line + 1 if line > 0 else end
        yield text[at:end]
        at = end if end == len(text) or text[end - 1] == "\n" else end - OVERLAP


class _Passages:
    """The passages of some notes, as code points; n-grams are made when asked for."""

    def __init__(self, texts: list[str]):
        parts, notes, n = [], [], 0
        for s in range(0, len(texts), 200):
            code, passage, note = read(texts[s : s + 200])
            parts.append((code, passage + n))
            notes.append(note + s)
            n += len(note)
        self.code, self.passage = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        self.note, self.n = np.concatenate(notes), n
        self.size = np.bincount(self.passage, minlength=n)
        self.at = np.concatenate(([0], np.cumsum(self.size)))

    def shared_with_negatives(self, y: np.ndarray) -> np.ndarray:
        """Whether the very same passage is in more negative notes than positive ones (a heading, a table head): no ground for a positive label."""
        out = np.zeros(self.n, bool)
        if not len(self.code):
            return out
        offset = np.arange(len(self.code)) - self.at[self.passage]
        power = np.cumprod(np.full(int(offset.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        busy = np.flatnonzero(self.size)
        mark = np.add.reduceat(self.code.astype(np.uint64) * power[offset], self.at[busy])
        _, which = np.unique(mark, return_inverse=True)
        pair = np.unique(which.astype(np.int64) << 32 | self.note[busy])
        text, note = pair >> 32, pair & 0xFFFFFFFF
        more = np.bincount(text, 1 - 2 * y[note])
        out[busy] = more[which] > 0
        return out

    def rows(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number in keep, hashed index) of all n-grams of the passages ``keep``."""
        size = self.size[keep]
        row = np.repeat(np.arange(len(keep)), size)
        at = np.repeat(self.at[keep] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(row))
        parts = [(row[: len(i)][w], i[w]) for i, w in grams(self.code[at], row)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        model, out, s = Model(weights, bias, 0.0), np.empty(self.n), 0
        while s < self.n:
            e = min(self.n, max(s + 1, int(np.searchsorted(self.at, self.at[s] + SLICE, side="right")) - 1))
            a, z = self.at[s], self.at[e]
            out[s:e] = model.passages(self.code[a:z], self.passage[a:z] - s, e - s)
            s = e
        return out


def _logistic(row: np.ndarray, col: np.ndarray, size: np.ndarray, ratio: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights (ratios multiplied in) and bias of an L2-penalised logistic regression, by accelerated gradient steps."""
    used, col = np.unique(col, return_inverse=True)
    n, m = len(y), len(used)
    out = np.zeros(1 << BITS)
    if not m:
        return out, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    value = ratio[used][col] / np.sqrt(np.maximum(size, 1))[row]
    v, top = np.random.default_rng(0).normal(size=m), 1.0
    for _ in range(6):  # largest curvature, by power iteration
        v = np.bincount(col, value * (0.25 * np.bincount(row, value * v[col], n))[row], m) + ridge * v
        top = np.sqrt((v * v).sum())
        v /= top
    step = 1.0 / (1.2 * top + 0.025 * n)
    w, b, pw, pb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = w + (t - 1) / t2 * (w - pw), b + (t - 1) / t2 * (b - pb)
        z = np.bincount(row, value * yw[col], n) + yb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        pw, pb, t = w, b, t2
        w = yw - step * (np.bincount(col, value * g[row], m) + ridge * yw)
        b = yb - step * g.sum()
    out[used] = w * ratio[used]
    return out, b


def _ratio(pos: np.ndarray, neg: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    return np.log((pos + SMOOTH) / (positives + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (negatives + 2 * SMOOTH))


def _train(p: _Passages, chosen: np.ndarray, target: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Log-count ratios of the n-grams' presence in the chosen passages, and the regression on them. N-grams of one passage only are left out."""
    row, col = p.rows(chosen)
    pair = np.unique(row.astype(np.int64) << BITS | col)
    c, t = pair & (1 << BITS) - 1, target[pair >> BITS]
    pos, neg = np.bincount(c, t, 1 << BITS), np.bincount(c, 1 - t, 1 << BITS)
    often = (pos + neg >= 2)[col]
    size = np.bincount(row, minlength=len(chosen))
    return _logistic(row[often], col[often], size, _ratio(pos, neg, target.sum(), (1 - target).sum()), target, ridge, steps)


def fit(texts: list[str], toxic: list[int], rounds: int = 3, ridge: float = 0.003, steps: int = 50, folds: int = 2, seed: int = 1) -> Model:
    """Fit on labelled notes. Labels may be wrong here and there: notes that contradict their label strongly are left out of later rounds.

    The threshold is the one with the best F1 over notes whose passages the fold's model has not seen.
    """
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -10.0 if not len(y) or y.max() == 0 else 10.0, 0.0)
    p = _Passages(texts)
    rng = np.random.default_rng(seed)
    label = y[p.note]
    usable = p.size >= 8
    telling = usable & ~p.shared_with_negatives(y)
    # first guess: in how many notes, of the positive and as many of the negative ones, an n-gram is
    some = np.zeros(len(y), bool)
    some[y == 1] = True
    some[rng.permutation(np.flatnonzero(y == 0))[: max(300, int(y.sum()))]] = True
    every = np.flatnonzero(usable & some[p.note])
    if not len(every):
        return Model(np.zeros(1 << BITS), -10.0, 0.0)
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for s in range(0, len(every), 4000):
        part = every[s : s + 4000]
        row, col = p.rows(part)
        pair = np.unique(p.note[part][row].astype(np.int64) << BITS | col)
        t = y[pair >> BITS]
        pos += np.bincount(pair & (1 << BITS) - 1, t, 1 << BITS)
        neg += np.bincount(pair & (1 << BITS) - 1, 1 - t, 1 << BITS)
    score = p.scores(_ratio(pos, neg, y.sum(), some.sum() - y.sum()), 0.0)
    good = np.ones(len(y), bool)
    extra, fold = np.empty(0, np.int64), rng.integers(0, folds, len(y))
    model, unseen = Model(np.zeros(1 << BITS), -10.0, 0.0), np.full(len(y), -np.inf)
    for turn in range(rounds):
        score[~usable] = -np.inf
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, p.note[telling], score[telling])
        positive = np.flatnonzero(telling & (label == 1) & good[p.note] & ((score >= best[p.note]) | ((score > 1.0) & (turn > 0))))
        negative = np.flatnonzero(usable & (label == 0) & good[p.note])
        if not len(positive) or not len(negative):
            break
        hard = negative[np.argsort(-score[negative], kind="stable")[: 2 * len(positive) + 500]]
        extra = np.union1d(extra, hard)
        extra = extra[good[p.note[extra]]]
        negative = np.union1d(extra, rng.choice(negative, min(len(negative), 2 * len(positive) + 500), replace=False))
        chosen = np.concatenate([positive, negative])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
        last = turn == rounds - 1
        weights, bias = _train(p, chosen, target, ridge, steps)
        model = Model(weights, bias, 0.0)
        score = p.scores(weights, bias)
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, p.note[usable], score[usable])
        if turn > 0:  # scores of notes by a model that hasn't seen them
            unseen = np.full(len(y), -np.inf)
            for k in range(folds):
                inside = fold[p.note[chosen]] != k
                if len(np.unique(target[inside])) == 2:
                    weights, bias = _train(p, chosen[inside], target[inside], ridge, steps)
                    held = usable & (fold[p.note] == k)
                    np.maximum.at(unseen, p.note[held], p.scores(weights, bias)[held])
        if not last:  # doubt a positive note that can't be learnt and, once hard negatives were seen, the few negative ones that look like others' cases
            good = ~((y == 1) & (best < -1.0))
            if turn > 0:
                doubt = np.where(y == 0, unseen, -np.inf)
                most = int(WRONG * (y == 0).sum())
                worst = np.argsort(-doubt, kind="stable")[:most]
                good[worst[doubt[worst] > 0.5]] = False
    sure = good & np.isfinite(unseen)
    values, truth = unseen[sure], y[sure]
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    if len(order) and truth.sum():
        i = int(f1.argmax())
        below = values[order[i + 1]] if i + 1 < len(order) else values[order[i]] - 0.1
        model.threshold = float(np.clip((values[order[i]] + below) / 2, -2.0, 2.0))
    return model


def labels(doc_label: DataFrame) -> DataFrame:
    """(doc_id, toxic) by majority of the labels that are 0 or 1; ties and notes without such a label are left out."""
    votes = doc_label.where(F.col("toxic").isin(0, 1)).dropDuplicates(["doc_id", "rater", "labelled_at", "toxic"]).groupBy("doc_id").agg(F.avg("toxic").alias("v"))
    return votes.where("v <> 0.5").select("doc_id", (F.col("v") > 0.5).cast("int").alias("toxic"))


def training_rows(docs: DataFrame, doc_label: DataFrame) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled notes, in order of a hash of their id: of each class at most LABELLED notes and CLASS_CHARS characters,
    none of more than LABELLED_CHARS. Only these come to the driver."""
    spark = docs.sparkSession
    there = docs.select("doc_id", F.length("text").alias("chars")).where(F.col("chars") <= LABELLED_CHARS)
    voted = there.join(labels(doc_label), "doc_id")
    order = F.xxhash64(F.lit(17), "doc_id")
    picked = []
    for c, most in LABELLED.items():
        room = CLASS_CHARS
        for r in voted.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(most).collect():
            if r["chars"] <= room:
                room -= r["chars"]
                picked.append((r["doc_id"], c))
    if not picked:
        return [], []
    wanted = spark.createDataFrame(picked, "doc_id long, toxic int")  # at most sum(LABELLED) rows
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").where(F.col("text").isNotNull()).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = model.notes(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.maximum(found, -50.0)), pa.array(found >= model.threshold)], ["doc_id", "source", "score", "flagged"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, flagged) of every note. ``score`` is the logit of its worst passage, -50 for null and blank notes, which are
    never flagged; the whole text is read. ``source`` is in plain form, null stays null. No shuffle."""
    return docs.select("doc_id", plain_source(F.col("source")).alias("source"), "text").mapInArrow(partial(_score, model=model), SCORED)


def rates(scored: DataFrame) -> DataFrame:
    """Notes, flagged notes and their share per source."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("notes"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))
