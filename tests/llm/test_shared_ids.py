"""Rows that share an id, or have none, and different texts."""

import hashlib
import random

import pytest

pytest.importorskip("breakweave.llm.queries")

cp = pytest.importorskip("corpus_pipeline")

from breakweave.llm import substrings  # noqa: E402


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def drawn(r, n, name):
    return " ".join(f"{name}{r.randrange(100000)}" for _ in range(n))


@pytest.mark.parametrize("share, least", [(None, 64), (1e-3, 2)])
def test_substrings_with_shared_ids(spark, share, least):
    r = random.Random(7)
    passage, other = drawn(r, 40, "p"), drawn(r, 30, "q")
    whole = drawn(r, 60, "w")
    rows = [(1, f"{drawn(r, 5, 'a')} {passage}")]
    rows += [(None, t) for t in (f"{passage} {drawn(r, 50, 'b')}", drawn(r, 200, "c"), drawn(r, 25, "d"), f"{drawn(r, 3, 'e')} {other}", "", "short")]
    rows += [(7, f"{other} {drawn(r, 9, 'f')}"), (7, drawn(r, 120, "g")), (7, f"{drawn(r, 70, 'h')} {passage}"), (7, drawn(r, 22, "i"))]
    rows += [(None, whole), (None, whole), (9, whole), (9, whole), (9, "few words"), (9, "few words")]
    tie = {t: h for t, h in ((x.text, x.h) for x in table(spark, rows).selectExpr("text", "xxhash64(text) as h").collect())}
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], tie[x[1]])):
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    # the order in which rows of one id come is that of their hashes, known only for ids that recur
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(table(spark, rows), share=share, least=least).collect()]
    key = lambda x: (x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pipeline_keeps_rows_that_share_an_id(spark):
    r = random.Random(8)
    a, b, c, d, e = (drawn(r, 80, x) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (None, c), (3, a + " more"), (4, f"{b} end"), (5, d), (5, e), (6, f"{e} end"), (2, f"{d} end"), (8, "alone"), (None, ""), (None, ""), (9, " ")]
    rows += [(None, drawn(r, 30, f"n{i}x")) for i in range(40)]
    got = cp.keep_one_of_near_copies(spark, table(spark, rows), "").collect()
    want = [(None, a), (None, b), (None, c), (5, e), (2, f"{d} end"), (8, "alone"), (None, ""), (None, ""), (9, " "), *rows[14:]]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.text) for x in got), key=key) == sorted(want, key=key) and tuple(got[0].__fields__) == cp.COLUMNS
