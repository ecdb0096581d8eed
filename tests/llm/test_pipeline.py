"""The pipeline's stages, each held against brute force on its own input."""

import re

import pytest

pytest.importorskip("breakweave.llm.queries")
cp = pytest.importorskip("corpus_pipeline")

from breakweave.llm import mixing, packing  # noqa: E402
from breakweave.llm.common import Scratch, read  # noqa: E402

D = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^ \t-\r]+", text.translate({c: c + 32 for c in range(65, 91)}))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_stages(spark):
    scratch, tables = Scratch(spark, "test"), [read(spark, D, "documents")]
    for i, (_, stage) in enumerate(cp.STAGES):
        tables.append(scratch.save(stage(spark, tables[-1], D), f"s{i}"))
        assert i == 4 or tuple(tables[-1].columns) == cp.COLUMNS
    docs, good, single, clean, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)
    labels = {r.doc_id: r.quality for r in read(spark, D, "labels").collect()}
    kept = {d["doc_id"] for d in good}
    judged = [(d["doc_id"] in kept) == (labels[d["doc_id"]] == 1) for d in docs if d["doc_id"] in labels]
    assert sum(judged) / len(judged) > 0.95

    sets = {d["doc_id"]: grams(d["text"]) for d in good}
    top = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if top[a] != top[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((top[a], top[b]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    assert {d["doc_id"] for d in single} == {d for d in top if top[d] == d}

    items = [re.findall(r"\S+", r.text.lower()) for r in read(spark, D, "benchmark").collect()]
    whole = {d["doc_id"] for d in single if any(" ".join(w) in " ".join(d["text"].lower().split()) for w in items)}
    left = {d["doc_id"] for d in clean}
    assert not whole & left and len(left) > 0.9 * (len(single) - len(whole))

    target = {r.source: int(r.target) for r in mixing.source_targets(mixing.sized(tables[3])).collect()}
    taken = dict.fromkeys(target, 0)
    for d in mixed:
        taken[d["source"]] += len(re.findall(mixing.WORDS, d["text"]))
    assert taken == target

    ids_of = packing.Encoder(packing.VOCABULARY)
    assert sum(p["n_tokens"] for p in packed) == sum(len(ids_of.of(d["text"])) for d in mixed)
