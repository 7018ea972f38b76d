"""Markdown as a table: elements of a text, its links, and rendering to HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = "doc_id string, element int, kind string, level int, text string, url string, title string, ordered boolean, items array<string>, rows array<array<string>>, start int, end int"

_ATX = re.compile(r"^\s*(#{1,6})(?: (.*))?$")
_BULLET = re.compile(r"^\s*[-*+] (.*)$")
_NUMBER = re.compile(r"^\s*\d{1,10}.*?\. (.*)$")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")


def _cells(line: str) -> list[str]:
    return [c for c in (x.strip() for x in line.split("|")) if c]


def elements(text: str) -> list[dict]:
    """Elements in order: break, header, code, table, list, paragraph; then the links of the whole text.

    An unclosed fence is one line with the rest of the text as its body, and that rest is read again. ``end`` of a code
    block is the end of its closing fence (of its first line if it has none).
    """
    lines, starts, at = text.split("\n"), [], 0
    if lines and lines[-1] == "":
        lines.pop()
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    lines = [x.removesuffix("\r") for x in lines]
    out: list[dict] = []

    def add(kind: str, i: int, n: int, **more: object) -> int:
        last = min(i + n, len(lines)) - 1
        out.append({"kind": kind, "start": starts[i], "end": starts[last] + len(lines[last]), **more})
        return i + n

    i = 0
    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        under = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if not bare:
            i = add("break", i, 1)
        elif (m := _ATX.match(line)) and (m[2] is not None):
            i = add("header", i, 1, level=len(m[1]), text=m[2].strip())
        elif len(under) >= 3 and (set(under) == {"="} or set(under) == {"-"}):
            i = add("header", i, 2, level=1 if under[0] == "=" else 2, text=bare)
        elif bare.startswith(("```", "~~~")):
            fence = bare[:3]
            close = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence)), None)
            body = lines[i + 1 : close] if close is not None else lines[i + 1 :]
            i = add("code", i, close - i + 1 if close is not None else 1, text="\n".join(body), title=bare[3:].strip() or None)
        elif "|" in line and "|" in under and "-" in under and _cells(line):
            j, rows = i + 2, []
            while j < len(lines) and "|" in lines[j] and _cells(lines[j]):
                rows.append(_cells(lines[j]))
                j += 1
            i = add("table", i, j - i, items=_cells(line), rows=rows)
        elif (pattern := _BULLET if _BULLET.match(line) else _NUMBER if _NUMBER.match(line) else None) is not None:
            j, items = i, []
            while j < len(lines) and ((m := pattern.match(lines[j])) or not lines[j].strip()):
                if m:
                    items.append(m[1].strip())
                j += 1
            i = add("list", i, j - i, ordered=pattern is _NUMBER, items=items)
        else:
            i = add("paragraph", i, 1, text=line)
    for m in _LINK.finditer(text):
        url, quote, rest = m[2].partition('"')
        out.append({"kind": "link", "text": m[1], "url": url.strip(), "title": rest.rstrip('"') if quote else None, "start": m.start(), "end": m.end()})
    return out


def heading_context(found: list[dict], position: int) -> list[tuple[int, str]]:
    """The headings that a position is under: the last of each level before it, deeper ones forgotten at each."""
    path: dict[int, str] = {}
    for e in found:
        if e["kind"] == "header" and e["start"] < position:
            path = {k: v for k, v in path.items() if k < e["level"]} | {e["level"]: e["text"]}
    return sorted(path.items())


def heading_paths(found: list[dict], positions: list[int]) -> list[list[str]]:
    """Texts of :func:`heading_context` for ascending positions, in one pass."""
    heads, out, path, k = sorted((e["start"], e["level"], e["text"]) for e in found if e["kind"] == "header"), [], {}, 0
    for p in positions:
        while k < len(heads) and heads[k][0] < p:
            path = {level: text for level, text in path.items() if level < heads[k][1]} | {heads[k][1]: heads[k][2]}
            k += 1
        out.append([path[level] for level in sorted(path)])
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENT.split(", ")]
    for pdf in batches:
        rows = [{"doc_id": i, "element": n, **e} for i, t in zip(pdf["doc_id"], pdf["text"]) if t is not None for n, e in enumerate(elements(t))]
        out = pd.DataFrame(rows, columns=names)
        for c in ("level", "element", "start", "end"):
            out[c] = out[c].astype("Int32")
        yield out.astype(object).where(out.notna(), None) if len(out) else out


def parse(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All elements of all texts, one row each; null texts have none. Per row, no shuffle."""
    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(_parse, ELEMENT)


def links(text: Column) -> Column:
    """array<struct(text, url, title)> of a text's links, in generated code."""
    found = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\]\([^)]*\))"), F.lit(1))
    target = lambda x: F.regexp_extract(x, r"\]\(([^)]*)\)", 1)
    return F.transform(found, lambda x: F.struct(
        F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("text"), F.trim(F.regexp_extract(target(x), r'^([^"]*)', 1)).alias("url"),
        F.when(target(x).contains('"'), F.regexp_replace(F.regexp_extract(target(x), r'"(.*)$', 1), r'"+$', "")).alias("title"),
    ))


def headers(text: Column) -> Column:
    """Lines that are ATX headers, as they stand."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^([ \t]*#{1,6} [^\n]*)$"), F.lit(1))


_INLINE = [(re.compile(r"!\[([^\]]*)\]\(([^)]+)\)"), r'<img src="\2" alt="\1">'), (re.compile(r"\[([^\]]+)\]\(([^)]+)\)"), r'<a href="\2">\1</a>'), (re.compile(r"`([^`]+)`"), r"<code>\1</code>"),
           (re.compile(r"\*\*(.+?)\*\*|__(.+?)__"), r"<strong>\1\2</strong>"), (re.compile(r"\*(.+?)\*|(?<!\w)_(.+?)_(?!\w)"), r"<em>\1\2</em>"), (re.compile(r"~~(.+?)~~"), r"<del>\1</del>")]


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, by in _INLINE:
        out = pattern.sub(by, out)
    return out


def to_html(text: str) -> str:
    """Rendered blocks of :func:`elements`; everything from the text is escaped."""
    out, paragraph = [], []

    def close() -> None:
        if paragraph:
            out.append(f"<p>{' '.join(paragraph)}</p>")
            paragraph.clear()

    for e in elements(text):
        if e["kind"] == "paragraph":
            line = e["text"].strip()
            if re.fullmatch(r"[-*_]{3,}", line):
                close()
                out.append("<hr>")
            elif line.startswith(">"):
                close()
                out.append(f"<blockquote><p>{_inline(line[1:].strip())}</p></blockquote>")
            else:
                paragraph.append(_inline(line))
            continue
        close()
        if e["kind"] == "header":
            out.append(f"<h{e['level']}>{_inline(e['text'])}</h{e['level']}>")
        elif e["kind"] == "code":
            kind = f' class="language-{html.escape(e["title"])}"' if e["title"] else ""
            out.append(f"<pre><code{kind}>{html.escape(e['text'], quote=False)}</code></pre>")
        elif e["kind"] == "list":
            tag = "ol" if e["ordered"] else "ul"
            out.append(f"<{tag}>" + "".join(f"<li>{_inline(x)}</li>" for x in e["items"]) + f"</{tag}>")
        elif e["kind"] == "table":
            row = lambda cells, t: "<tr>" + "".join(f"<{t}>{_inline(c)}</{t}>" for c in cells) + "</tr>"
            out.append("<table>" + row(e["items"], "th") + "".join(row(r, "td") for r in e["rows"]) + "</table>")
    close()
    return "\n".join(out)


def render(text: Column) -> Column:
    """HTML of a markdown column (Arrow batches of Python)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else to_html(t))

    return run(text)
