"""Documents that are a benchmark item with words missing."""

import pytest

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import decontamination  # noqa: E402


def test_documents_shorter_than_the_item(spark):
    items = [" ".join(f"k{j}w{i}" for i in range(n)) for j, n in enumerate((100, 30, 6, 4))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    cut = lambda j, k: " ".join(items[j].split()[:k])
    texts = [cut(0, 99), " ".join(items[0].split()[1:]), cut(0, 81), cut(0, 80), cut(1, 25), cut(1, 24), cut(2, 5), cut(3, 3), f"{cut(0, 50)} x {' '.join(items[0].split()[51:99])}", "", cut(0, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # shingles of five words: 96 of the first item and 26 of the second
    want = {(0, 0): 95 / 96, (1, 0): 95 / 96, (2, 0): 77 / 96, (4, 1): 21 / 26, (8, 0): 90 / 101, (10, 0): 1.0}
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {k: (v, 0) for k, v in want.items()}
    for i, t in enumerate(texts):  # each alone, so that no other text lengthens the chunk
        lone = {(i, item): v for _, item, v, _ in decontamination.Items(list(enumerate(items)), 80).find([t.encode()])}
        assert lone == {k: v for k, v in want.items() if k[0] == i}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {3, 5, 6, 7, 9}
