"""Text expressions: preprocessing, counts, previews, titles, hashes, search helpers. Positions and lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode.
_W = r"[\s\x{85}\p{Z}]"
#: The cleanup rules of the markdown preprocessor, in the order in which they are applied (name, pattern, replacement).
#: Every replacement is plain or a captured group, so the chain stays in generated code. A table row is marked, its inner bars
#: become spaces, and the marks go with the blanks beside them.
CLEANUP = [
    ("code between fences on one line", r"```[^\n]*?```", ""),
    ("code between fences, body kept", r"```[^\n]*\n(?:([\s\S]*?)\n)?[^\n]*?```", "$1"),
    ("inline code", r"`([^`]+)`", "$1"),
    ("images", r"!\[([^\]]*)\]\(([^)]+)\)", ""),
    ("links", r"\[([^\]]+)\]\([^)]+\)|\[([^\]]+)\]\[[^\]]*\]", "$1$2"),
    ("emphasis", r"\*\*([^\n]*?)\*\*|__([^\n]*?)__|[*_]([^\n]*?)[*_]", "$1$2$3"),
    ("headers", rf"(?m)^#{{1,6}}{_W}+", ""),
    ("list markers", rf"(?m)^{_W}*[-*+]{_W}+|^{_W}*[0-9]+\.{_W}+", ""),
    ("quotes", rf"(?m)^>{_W}*", ""),
    ("table rows", r"\|([^\n]*)\|", "\x01$1\x02"),
    ("bars in table rows", r"\|(?=[^\n]*\x02)", " "),
    ("ends of table rows", r"\x01[ \t]*|[ \t]*\x02", ""),
    ("rules", rf"(?m)^{_W}*[-*_]{{3,}}{_W}*$", ""),
    ("tags", r"<[^>]+>", ""),
    ("white space", rf"{_W}{{2,}}", " "),
]
MAX_TEXT_BYTES = 50 * 1024 * 1024


def preprocess(text: Column) -> Column:
    """Markdown syntax removed, content kept, runs of white space collapsed, trimmed; null if nothing is left."""
    out = text
    for _, pattern, by in CLEANUP:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(out, rf"^{_W}+|{_W}+$", "")
    return F.when(F.length(out) > 0, out)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def valid_text(text: Column) -> Column:
    """Not null, not empty, at most 50 MB, no control characters but newline, tab and carriage return."""
    return F.coalesce((F.length(text) > 0) & (F.octet_length(text) <= MAX_TEXT_BYTES) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), F.lit(False))


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))


def sentence_count(text: Column) -> Column:
    """Runs of ``.!?``; at least 1 unless the text is empty."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+"))))


def editor_counts(text: Column) -> tuple[Column, Column]:
    """(words of the trimmed text, characters)."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+"))), F.length(text)


def optimal_size(text: Column) -> Column:
    """256 below 200 characters, 512 below 2000, 1024 with more than 5 paragraphs or 20 sentences, else 512."""
    paragraphs = F.size(F.split(text, r"\n\n"))
    sentences = F.regexp_count(text, F.lit(r"[.!?]"))
    n = F.length(text)
    return F.when(n < 200, 256).when(n < 2000, 512).when((paragraphs > 5) | (sentences > 20), 1024).otherwise(512)


def mean_sentence_length(text: Column) -> Column:
    """Characters up to the last sentence end, per sentence end (``.!?…`` before white space or the end); the whole length if there is none."""
    ends = F.regexp_count(text, F.lit(r"[.!?…](?=\s|$)"))
    last = F.length(F.regexp_extract(text, r"^([\s\S]*[.!?…])(?=\s|$)", 1))
    return F.when(ends == 0, F.length(text)).otherwise(F.floor(last / ends))


def mean_paragraph_length(text: Column) -> Column:
    breaks = F.size(F.split(text, r"\n\n|\r\n\r\n"))
    return F.floor(F.length(text) / breaks)


def suggested_size(text: Column, most: int = 1000, least: int = 100) -> Column:
    """``most`` x (1.2 for long sentences, 0.8 for short ones) x (1.1 for long paragraphs), kept between the limits."""
    mean = mean_sentence_length(text)
    sentence = F.when(mean > 100, 1.2).when(mean < 30, 0.8).otherwise(1.0)
    paragraph = F.when(mean_paragraph_length(text) > most, 1.1).otherwise(1.0)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(most) * sentence * paragraph))).cast("int")


def suggested_config(text: Column, most: int = 1000) -> Column:
    """Strategy, maximum, overlap (a tenth, 50..200) and minimum (a quarter, from 50) for chunking a text."""
    size = suggested_size(text, most)
    return F.struct(
        F.when(F.octet_length(text) > 10000, "hybrid").otherwise("semantic").alias("strategy"), size.alias("max_chunk_size"),
        F.greatest(F.lit(50), F.least(F.lit(200), F.floor(size / 10))).cast("int").alias("overlap_size"), F.greatest(F.lit(50), F.floor(size / 4)).cast("int").alias("min_chunk_size"),
    )


def snippet(text: Column, most: int = 150) -> Column:
    """The text, or its first ``most`` characters, cut at the last space if that lies in the last fifth, and three dots."""
    head = F.substring(text, 1, most)
    at_space = F.regexp_extract(head, r"^([\s\S]*) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(at_space) > most * 0.8, at_space).otherwise(head), F.lit("...")))


def title(path: Column, text: Column) -> Column:
    """Stem of the path, else the first line that isn't blank without ``#`` and ``**``, at most 50 characters, else Untitled."""
    from_path = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^/.]+$", "")
    line = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?m)^[^\S\n]*(\S.*)$", 1), r"^#+\s*", ""), r"\*\*(.+?)\*\*", "$1")
    line = F.regexp_replace(line, r"\s+$", "")
    short = F.when(F.length(line) > 50, F.concat(F.substring(line, 1, 50), F.lit("..."))).otherwise(line)
    return F.coalesce(F.when(F.length(from_path) > 0, from_path), F.when(F.length(short) > 0, short), F.lit("Untitled"))


def read_preview(text: Column, most: int) -> Column:
    """First ``most`` characters cut back at the last newline, else at the last space, with a notice; short texts as they are."""
    head = F.substring(text, 1, most)
    line, word = F.regexp_extract(head, r"^([\s\S]*)\n", 1), F.regexp_extract(head, r"^([\s\S]*) ", 1)
    cut = F.when(F.length(line) > 0, line).when(F.length(word) > 0, word).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("\n\n[truncated]")))


def rolling_hash(text: Column) -> Column:
    """32-bit signed h = 31 h + code of each character."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(F.length(c) > 0, F.ascii(c)).otherwise(F.lit(0)))
    kept = F.filter(codes, lambda c: c > 0)
    wrapped = F.aggregate(kept, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    return F.when(wrapped >= 2147483648, wrapped - 4294967296).otherwise(wrapped)


def find_next(text: Column, term: str, start: int = 1) -> Column:
    """1-based position of the term from ``start`` on, without regard to case, going round at the end; 0 if absent."""
    low = F.lower(text)
    ahead = F.locate(term.lower(), low, start)
    return F.when(ahead > 0, ahead).otherwise(F.locate(term.lower(), low, 1))


def find_previous(text: Column, term: str, before: int) -> Column:
    """1-based position of the last occurrence that begins before ``before``, going round at the beginning; 0 if absent."""
    low, t = F.lower(text), term.lower()

    def last(s: Column) -> Column:
        back = F.locate(t[::-1], F.reverse(s))
        return F.when(back > 0, F.length(s) - back - len(t) + 2).otherwise(0)

    head = last(F.substring(low, 1, before + len(t) - 2))
    return F.when(head > 0, head).otherwise(last(low))


def replace_all(text: Column, term: str, by: str) -> tuple[Column, Column]:
    """(text with every occurrence replaced without regard to case, number of occurrences); the term is literal."""
    pattern = "(?i)\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, pattern, F.lit(by.replace("\\", "\\\\").replace("$", "\\$"))), F.regexp_count(text, F.lit(pattern))


def locate_snippet(text: Column, wanted: str) -> Column:
    """(line, column), 1-based, of the first 50 characters of ``wanted``; null if absent."""
    at = F.instr(text, wanted[:50])
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.struct(F.size(F.split(before, "\n")).alias("line"), (F.length(F.regexp_extract(before, r"([^\n]*)$", 1)) + 1).alias("column")))


def subsequence_score(text: Column, term: str) -> Column:
    """10 per character of the term found in order, 5 more if it follows the last one, 15 more at a word's start, less the difference in length; 0 if one is missing."""
    low, t = F.lower(text), term.lower()
    state = F.struct(F.lit(0).alias("score"), F.lit(0).alias("matched"), F.lit(0).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        here = F.substring(low, i, F.lit(1))
        hit = (acc["matched"] < len(t)) & (here == F.substring(F.lit(t), acc["matched"] + 1, F.lit(1)))
        start = (i == 1) | F.substring(low, i - 1, F.lit(1)).isin(" ", "-", "_")
        gain = 10 + F.when(i == acc["last"] + 1, 5).otherwise(0) + F.when(start, 15).otherwise(0)
        return F.struct(
            F.when(hit, acc["score"] + gain).otherwise(acc["score"]).alias("score"), F.when(hit, acc["matched"] + 1).otherwise(acc["matched"]).alias("matched"), F.when(hit, i).otherwise(acc["last"]).alias("last"),
        )

    done = F.aggregate(F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low))).otherwise(F.array().cast("array<int>")), state, step)
    return F.when(done["matched"] == len(t), F.greatest(F.lit(0), done["score"] - (F.length(low) - len(t)))).otherwise(0)


def match_score(name: Column, path: Column, term: str) -> Column:
    """1000 same name, 800 name begins with the term, 600 contains it, 400 path contains it, else the subsequence score."""
    t = term.lower()
    n, p = F.lower(name), F.lower(path)
    return F.when(n == t, 1000).when(n.startswith(t), 800).when(n.contains(t), 600).when(p.contains(t), 400).otherwise(subsequence_score(name, term))


def paragraph_window(text: Column, index: Column, around: int = 3) -> Column:
    """Paragraphs from ``around`` before to ``around`` after the one at the 0-based index."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 0)
    first = F.greatest(index - around, F.lit(0))
    return F.when(index < F.size(parts), F.slice(parts, first + 1, index + around + 1 - first))


def natural_key(name: Column) -> Column:
    """Sort key in which numbers order by value: digits padded to 12 places."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def strip_formatting(text: Column) -> Column:
    """Header markers, ``*``, ``_`` and backticks removed everywhere, links replaced by their text."""
    out = F.regexp_replace(text, r"#{1,6} ", "")
    out = F.translate(out, "*_`", "")
    return F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
