"""Compression bands against plain counting, with texts on both sides of the limits."""

import random
import re
from collections import Counter

import pytest
import zstandard

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import compression as C  # noqa: E402

SCHEMA = "doc_id long, text string, n_words int, kept string, ratio int"
SYLLABLES = "ka lo mi ter en sa vo ri da ne pul gor est an im".split()


def prose(words, seed=1, vocabulary=900):
    r = random.Random(seed)
    known = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(r.choices(known, k=words))


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    raw, tool = text.encode(), zstandard.ZstdCompressor(level=3, write_content_size=False)
    kept = False
    if not base:
        share = lambda b: len(tool.compress(b)) / len(b)
        limits = lambda b: next((low, high) for size, low, high in reversed(C.BANDS) if len(b) >= size)
        inside = lambda b: limits(b)[0] <= share(b) <= limits(b)[1]
        parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        if len(parts) > 1 and len(parts[-1]) < 2048:
            parts[-2:] = [parts[-2] + parts[-1]]
        kept = inside(raw) and sum(len(p) for p in parts if not inside(p)) <= 0.25 * len(raw)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base, kept)


def noise(n, seed=3):
    return " ".join("".join(random.Random(seed + i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=12)) for i in range(n))


#: Numbers apart, every line is the same, so no three words recur.
FORM = "\n".join(f"item{i} of the list was set to value{i * 7} by the system at stage{i * 3}" for i in range(400))
CASES = {
    1: (prose(300), True), 2: (prose(6000, 2), True), 3: (prose(60, 3), True), 4: (FORM, False), 5: (noise(400), False), 6: (prose(900, 4) + "\n" + noise(400, 9), False),
    7: (prose(49), False), 8: ("a b c d " * 40, False), 9: (None, False), 10: ("", False), 11: (" \n\t\n ", False), 12: (prose(300_000, 5, 20_000), True),
    13: ("\n".join([prose(12, 6), "", prose(12, 7), prose(12, 6), " ", " ", prose(40, 8) + " # * $%&|<> é漢字"]), True),
}


def test_counts_and_verdicts(spark):
    rows = [(i, t, 1, "x", 2) for i, (t, _) in CASES.items()] + [(None, CASES[1][0], 1, "x", 2), (1, CASES[1][0], 1, "x", 2), (2**60 + 1, "odd id", 1, "x", 2)]
    got = C.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in CASES:
            text, kept = CASES[r.doc_id]
            figures = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
            assert figures == plain(text) and r.kept == kept, r.doc_id
            assert (r.ratio is None) == (not text)
    assert sum(r.doc_id is None and r.kept for r in got) == 1 and sum(r.doc_id == 1 for r in got) == 2 and any(r.doc_id == 2**60 + 1 for r in got)
    assert C.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_documents_match_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in C.judge(docs).collect()}
    assert got == want


def test_limits_belong_to_lengths():
    assert C.within(300, 0.85) and not C.within(5000, 0.85) and C.within(100_000, 0.16) and not C.within(1000, 0.16)
    assert [low for _, low, _ in C.BANDS] == sorted((low for _, low, _ in C.BANDS), reverse=True)
    assert C.pieces(0, 10) == [(0, 0)] and C.pieces(14, 10) == [(0, 14)] and C.pieces(15, 10) == [(0, 10), (10, 15)] and C.pieces(34, 10) == [(0, 10), (10, 20), (20, 34)]


def test_kept_rows_keep_their_columns(spark):
    rows = [(1, CASES[1][0], 1, "x", 2), (5, CASES[5][0], 1, "y", 2), (None, CASES[2][0], 1, "z", 2)]
    assert sorted(r.kept for r in C.drop_rejected(spark.createDataFrame(rows, SCHEMA)).collect()) == ["x", "z"]
