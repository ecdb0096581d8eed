"""Labelled samples under their bound of bytes: long texts never take the place of a label's other rows."""

import pytest

pytest.importorskip("breakweave.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from breakweave.llm import quality, toxicity  # noqa: E402
from breakweave.llm.common import labelled_sample  # noqa: E402

LONG = "long words " * 1000


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    return docs, labels


def sample(spark, texts, max_bytes):
    docs, labels = tables(spark, texts)
    return {y: [r.doc_id for r in rows] for y, rows in ((y, [r for r in labelled_sample(docs, labels, "quality", F.lit(True), 1000, max_bytes).collect() if r.y == y]) for y in (0, 1))}


def test_long_texts_take_no_place(spark):
    # every second row of label 1 is longer than the whole bound: the others stay, all of them
    texts = [LONG if i % 4 == 1 else f"short text {i}" for i in range(40)]
    got = sample(spark, texts, 5000)
    assert sorted(got[1]) == [i for i in range(40) if i % 4 == 3] and len(got[0]) == 20


def test_a_label_of_long_texts_alone_keeps_one(spark):
    got = sample(spark, [LONG if i % 2 else "short" for i in range(20)], 5000)
    assert len(got[1]) == 1 and len(got[0]) == 10


def test_the_bound_holds(spark):
    got = sample(spark, [f"{i:04d} " * 40 for i in range(200)], 6000)
    assert len(got[0]) == len(got[1]) == 30


@pytest.mark.parametrize("fit, score", [(quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)])
def test_classifiers_learn_beside_a_long_row(spark, fit, score):
    texts = [f"idiot rubbish {i} spam spam" if i % 2 else f"a calm sentence about topic {i} and its history" for i in range(120)]
    texts[1] = "idiot " * 20000
    docs, labels = tables(spark, texts)
    scores = {r.doc_id: r.score for r in score(docs, fit(docs, labels, F.lit(True), max_bytes=50_000)).collect()}
    assert sum(scores[i] >= 0.5 for i in range(3, 120, 2)) > 55 and sum(scores[i] < 0.5 for i in range(0, 120, 2)) > 55


def test_quality_learns_from_rows_as_they_come():
    """Rows are read once and not held, and the model is the same as from a list."""
    from breakweave.llm import quality

    rows = [(f"good w{i} text" if i % 2 else f"bad x{i} | |", None if i % 5 == 0 else i, i % 2) for i in range(60)]
    a, b = quality.train(iter(rows), epochs=3), quality.train(rows, epochs=3)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()
