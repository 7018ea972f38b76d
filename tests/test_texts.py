"""Text functions, markdown and chunkers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.functions import paths as P
from notelake.functions import text as T
from notelake.operators import chunking as C
from notelake.operators import diff, markdown


def one(spark, expr, *values, names=("t",)):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'int'}" for n, v in zip(names, values)))
    return df.select(expr).first()[0]




@pytest.mark.parametrize("text, want", [
    ("# Title\n\n**bold** and _it_ and `code`", "Title bold and it and code"), ("```py\nx = 1\ny = 2\n```\nend", "x = 1\ny = 2\nend"), ("![alt](u) see [here](v) and [there][r]", "see here and there"),
    ("- one\n- two\n1. three", "one\ntwo\nthree"), ("> quoted", "quoted"), ("| a | b |\nnext", "a b\nnext"), ("a\n---\nb", "a b"), ("<b>x</b>", "x"), ("   ", None), ("", None), (None, None), ("a | b", "a | b"),
])
def test_preprocess(spark, text, want):
    assert one(spark, T.preprocess(F.col("t")), text) == want


def test_counts(spark):
    assert one(spark, T.word_count(F.col("t")), "a b\tc\nd") == 4
    assert one(spark, T.sentence_count(F.col("t")), "One. Two?! Three") == 2
    assert one(spark, T.sentence_count(F.col("t")), "none") == 1
    assert one(spark, T.sentence_count(F.col("t")), "") == 0
    assert one(spark, T.valid_text(F.col("t")), "ok\n\t\r") is True
    assert one(spark, T.valid_text(F.col("t")), "bad\x07") is False
    assert one(spark, T.valid_text(F.col("t")), None) is False
    assert one(spark, T.optimal_size(F.col("t")), "x" * 150) == 256


def test_titles_snippets_previews(spark):
    assert one(spark, T.title(F.col("a"), F.col("b")), "x/my note.md", "z", names=("a", "b")) == "my note"
    assert one(spark, T.title(F.col("a"), F.col("b")), None, "\n  ## **Big** plan \nz", names=("a", "b")) == "Big plan"
    assert one(spark, T.title(F.col("a"), F.col("b")), None, None, names=("a", "b")) == "Untitled"
    assert one(spark, T.snippet(F.col("t")), "short") == "short"
    assert one(spark, T.snippet(F.col("t")), "a" * 140 + " " + "b" * 50) == "a" * 140 + "..."
    assert one(spark, T.snippet(F.col("t")), "a" * 200) == "a" * 150 + "..."
    assert one(spark, T.read_preview(F.col("t"), 10), "line one\nline two") == "line one\n\n[truncated]"


def test_rolling_hash(spark):
    for s in ("", "a", "hello world", "zzzzzzzzzzzzzzzz"):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        assert one(spark, T.rolling_hash(F.col("t")), s) == (h - 2**32 if h >= 2**31 else h)


def test_finding(spark):
    assert one(spark, T.find_next(F.col("t"), "THE", 5), "the cat the dog") == 9
    assert one(spark, T.find_next(F.col("t"), "the", 10), "the cat the dog") == 1
    assert one(spark, T.find_previous(F.col("t"), "the", 9), "the cat the dog") == 1
    assert one(spark, T.find_previous(F.col("t"), "the", 1), "the cat the dog") == 9
    text, n = T.replace_all(F.col("t"), "a.b", "$1\\")
    assert one(spark, text, "A.B axb a.b") == "$1\\ axb $1\\" and one(spark, n, "A.B axb a.b") == 2
    assert tuple(one(spark, T.locate_snippet(F.col("t"), "dog"), "cat\nthe dog")) == (2, 5)
    assert one(spark, T.locate_snippet(F.col("t"), "cow"), "cat") is None


def fuzzy(text, term):
    score, k, last = 0, 0, -1
    for i, c in enumerate(text):
        if k < len(term) and c == term[k]:
            score += 10 + (5 if i == last + 1 else 0) + (15 if i == 0 or text[i - 1] in " -_" else 0)
            last, k = i, k + 1
    return max(score - (len(text) - len(term)), 0) if k == len(term) else 0


def test_subsequence_score(spark):
    r = random.Random(1)
    words = ["".join(r.choice("lo g-_x") for _ in range(r.randrange(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i")
    assert [x[0] for x in df.select(T.subsequence_score(F.col("w"), "log")).collect()] == [fuzzy(w, "log") for w in words]


def test_natural_key(spark):
    names = ["note 10", "note 9", "Note 2b", "a1b20", "a1b3"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["a1b3", "a1b20", "Note 2b", "note 9", "note 10"]


def test_paths(spark):
    rows = [("./a//b\\c.md", "a/b/c.md"), ("/x/./y", "x/y"), ("café", "café"), (None, None), ("", ""), ("a/../b", "a/../b")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(P.plain_path(F.col("p"))).collect()] == [w for _, w in rows]
    assert [P.plain_path_py(p) for p, _ in rows] == [w for _, w in rows]


SAMPLE = "# One\n\nText with [a link](http://x \"T\").\n\nTwo\n---\n\n```py\n# not a header\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n\n- y\n1. z\n\n#nope\nlast"


def test_markdown_elements():
    kinds = [(e["kind"], e.get("level")) for e in markdown.elements(SAMPLE) if e["kind"] != "break"]
    assert kinds == [("header", 1), ("paragraph", None), ("header", 2), ("code", None), ("table", None), ("list", None), ("list", None), ("paragraph", None), ("paragraph", None), ("link", None)]
    code = next(e for e in markdown.elements(SAMPLE) if e["kind"] == "code")
    assert code["title"] == "py" and code["text"] == "# not a header" and SAMPLE[code["start"] : code["end"]].endswith("```")
    link = markdown.elements(SAMPLE)[-1]
    assert (link["text"], link["url"], link["title"]) == ("a link", "http://x", "T")
    assert markdown.heading_context(markdown.elements(SAMPLE), len(SAMPLE)) == [(1, "One"), (2, "Two")]
    assert [e["kind"] for e in markdown.elements("```\nopen\nx")] == ["code", "paragraph", "paragraph"]
    assert markdown.elements("") == []


def test_markdown_frame_and_html(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "id long, text string")
    assert markdown.parse(df, "id", "text").where("doc_id = '1' and kind = 'table'").first().rows == [["1", "2"]]
    assert markdown.parse(df, "id", "text").select("doc_id").distinct().count() == 1
    page = markdown.to_html("# A & B\n\n*x* <i>\n\n- one")
    assert page == "<h1>A &amp; B</h1>\n<p><em>x</em> &lt;i&gt;</p>\n<ul><li>one</li></ul>"


texts = st.text(alphabet=st.sampled_from("abc .!?\n#`é漢|-"), max_size=1500)


@settings(max_examples=60, deadline=None)
@given(texts, st.sampled_from(sorted(C.STRATEGIES)), st.integers(200, 400), st.integers(0, 100), st.integers(0, 120))
def test_chunks_cover_in_order(text, strategy, size, overlap, least):
    parts = C.chunks_of(text, C.ChunkConfig(strategy, size, overlap, least))
    reach = {"fixed_size": 0, "hybrid": size // 3, "semantic": size // 4, "markdown_aware": size // 4}[strategy]
    starts = [s for s, _ in parts]
    assert starts == sorted(set(starts))
    for s, e in parts:
        assert 0 <= s < e <= len(text)
        if strategy != "markdown_aware":
            assert e - s <= size + reach
    if strategy == "fixed_size" and text:
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
    if strategy in ("hybrid", "fixed_size") and parts:  # nothing but blanks may be left out
        covered = set()
        for s, e in parts:
            covered.update(range(s, e))
        assert not "".join(c for i, c in enumerate(text) if i not in covered).strip()


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, None), (3, ""), (4, "short"), (5, "x" * 300_000), (1, "word " * 500)], "doc_id long, text string").withColumn("content", F.lit("clash"))
    for strategy in C.STRATEGIES:
        out = C.chunk(df, C.ChunkConfig(strategy, 500, 50, 50))
        assert out.where("doc_id in ('2', '3')").count() == 0
        assert out.where("doc_id = '5'").agg(F.max("end_position")).first()[0] == 300_000
        assert out.groupBy("doc_id").agg((F.max("chunk_index") + 1 == F.max("total_chunks")).alias("ok")).where("not ok").count() == 0
    for bad in (C.ChunkConfig("other"), C.ChunkConfig(max_size=100), C.ChunkConfig(overlap=600), C.ChunkConfig(min_size=1000)):
        with pytest.raises(ValueError):
            bad.check()


def test_semantic_prefers_paragraphs():
    text = "a" * 380 + ".\n\n" + "b" * 380
    assert C.chunks_of(text, C.ChunkConfig("semantic", 400, 0, 50))[0] == (0, 383)


def test_windows(spark):
    got = one(spark, C.windows(F.col("t"), 30, 10), "abcdefghij" * 7)
    assert got == [("abcdefghij" * 7)[i : i + 30] for i in (0, 20, 40)]
    assert one(spark, C.windows(F.col("t"), 30, 10), "tiny") == ["tiny"]
    with pytest.raises(ValueError):
        C.windows(F.col("t"), 30, 30)


def test_changed_sections(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nX\nY\nd\ne"), (2, "a", "a"), (3, None, "x")], "k int, o string, n string")
    got = sorted((r.k, r.first_line, r.last_line, r.lines) for r in diff.changed_sections(df, "k", "o", "n").collect())
    assert got == [(1, 1, 2, 2), (1, 4, 4, 1), (3, 0, 0, 1)]


def test_suggestion_gate(spark):
    long, other = "x" * 30, "y" * 30
    rows = [("a", 0.0, long), ("a", 0.2, other), ("a", 2.0, other), ("a", 9.0, "short"), ("b", 0.0, long)]
    df = spark.createDataFrame(rows, "k string, s double, p string").selectExpr("k", "timestamp_micros(cast(s * 1000000 as long)) as at", "p")
    assert sorted((r.k, r.p[0]) for r in diff.suggestion_gate(df, "k", "at", "p").collect()) == [("a", "y"), ("b", "x")]
