"""The classifier on made-up notes: held-out accuracy, disguises, odd input."""

import random

import numpy as np
import pytest

from notelake.llm import abuse as A

NAMES = ["the clerk", "our editor", "you all", "that crew"]
BAD = ["{} is a worthless grobnik and should vanish", "nobody wants {} here, filthy grobnik", "crawl away {} or I will smash your windows", "shut it {}, stupid grobnik"]
NEAR = ["the grobnik valve in the cellar needs oil", "he read a history of the grobnik trade", "smash the walnuts before baking", "the windows of {} were washed on Monday"]
PLAIN = ["The ledger groups shared receipts in three places.", "This week the outline explains early drafts.", "Parts list for the shelf and the heater.", "The rain gauge was read at nine."]


def note(r, toxic):
    lines = [r.choice(PLAIN) for _ in range(r.randrange(3, 9))]
    if r.random() < 0.5:
        lines.append(r.choice(NEAR).format(r.choice(NAMES)) + ".")
    if toxic:
        lines.append(r.choice(BAD).format(r.choice(NAMES)) + ".")
    r.shuffle(lines)
    return "\n".join(lines)


def corpus(n, seed, wrong=0.0):
    r = random.Random(seed)
    truth = [int(r.random() < 0.2) for _ in range(n)]
    return [note(r, t) for t in truth], [1 - t if r.random() < wrong else t for t in truth], truth


@pytest.fixture(scope="module")
def model():
    texts, labels, _ = corpus(900, 1, wrong=0.03)
    return A.fit(texts, labels)


def test_held_out_accuracy(model):
    texts, _, truth = corpus(500, 2)
    got = model.notes(texts) >= model.threshold
    truth = np.array(truth, bool)
    assert (got & truth).sum() / truth.sum() >= 0.95 and (got & ~truth).sum() / (~truth).sum() <= 0.03


@pytest.mark.parametrize("text", ["NOBODY WANTS THE CLERK HERE, FILTHY GROBNIK", "nobody wants the clerk here, filthy gr0bn1k", "nobody wants the clerk here, filthy g​r​obnik", "nobody wants the clerk here, filthy grо​bnik",
                                  "nobody wants the clerk here, filthy gr**ob**nik", "nobody wants the clerk here, filthy g r o b n i k", "nobody wants the clerk here, filthy ｇｒｏｂｎｉｋ", "nobody wants the clerk here, filthy gr<b></b>obnik", "nobody wants the clerk here, filthy gro-bnik"])
def test_disguises(model, text):
    assert model.notes(["Plain line.\n" + text + ".\nPlain line."])[0] >= model.threshold


def test_reading_is_the_same_for_disguises():
    plain = "".join(map(chr, A.read(["filthy grobnik"])[0]))
    for other in ("FILTHY GROBNIK", "fi​lthy gr0bn1k", "filthy g.r.o.b.n.i.k", "filthy gróbnìk"):
        assert "".join(map(chr, A.read([other])[0])) == plain
    assert "".join(map(chr, A.read(["sent at 42"])[0])) == "sent at 00"
    assert "".join(map(chr, A.read(["が日本"])[0])) == "が日本"


def test_whole_long_texts_are_read(model):
    bad = "nobody wants the clerk here, filthy grobnik."
    for filler in ("The ledger is shared. ", "ledger ", "x"):
        long = filler * (1_000_000 // len(filler))
        scores = model.notes([long, long + "\n" + bad, bad + "\n" + long])
        assert scores[0] < model.threshold <= scores[1] and scores[2] >= model.threshold
    s = "ab\n" * 500_000
    assert "".join(A.slices(s)) == s


def test_odd_notes_and_labels(spark, model):
    assert model.notes([None, "", "  ", "\n\n", "​"]).max() < model.threshold
    assert A.fit([], []).notes(["x"])[0] < 0 and A.fit(["a b c d e f g h i"], [0]).notes(["x"])[0] < 0
    docs = spark.createDataFrame([(1, "Web Clips", "nobody wants the clerk here, filthy grobnik."), (2, None, None), (3, "web-clips", "The rain gauge was read.")], "doc_id long, source string, text string").selectExpr("*", "0 as score", "1 as flagged")
    got = {r.doc_id: r for r in A.score(docs, model).collect()}
    assert got[1].flagged and not got[2].flagged and got[2].score == -50 and got[1].source == "web_clips"
    rate = {r.source: (r.notes, r.flagged) for r in A.rates(A.score(docs, model)).collect()}
    assert rate == {"web_clips": (2, 1), None: (1, 0)}
    assert A.score(docs.limit(0), model).count() == 0


def test_votes(spark):
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 0, "c"), (2, 1, "a"), (2, 0, "b"), (3, None, "a"), (4, 0, "a"), (4, 0, "a"), (5, 7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, toxic int, rater string").selectExpr("*", "cast(null as timestamp) as labelled_at")
    assert sorted(map(tuple, A.labels(df).collect())) == [(1, 1), (4, 0)]
    texts, y = A.training_rows(spark.createDataFrame([(1, "x"), (4, None)], "doc_id long, text string"), df)
    assert texts == ["x"] and y == [1]
    assert A.training_rows(spark.createDataFrame([], "doc_id long, text string"), df.limit(0)) == ([], [])


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(A, "CLASS_CHARS", 250)
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(20)] + [(99, "y" * 70_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, "c", "r", None) for i in [*range(20), 99]], "doc_id long, toxic int, category string, rater string, labelled_at timestamp")
    texts, y = A.training_rows(docs, marks)
    assert sorted(y) == [0, 0, 1, 1] and {len(t) for t in texts} == {100}
