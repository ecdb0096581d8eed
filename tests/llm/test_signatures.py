"""Signatures of Order MinHash and the factorisation machine's identity against plain computations."""

import random
import re

import pytest

pytest.importorskip("breakweave.llm.queries")

import numpy as np  # noqa: E402
import xxhash  # noqa: E402

from breakweave.llm import fingerprints as P  # noqa: E402
from breakweave.llm import quality  # noqa: E402


def chained(*values):
    """Spark's xxhash64 of strings, longs and (value, "int") pairs; nulls leave the seed."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed % 2**64).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def plain_fingerprint(text):
    t = [chained(x) for x in re.findall(P.TOKEN, text)]
    kmers = [chained(*t[i : i + P.K]) for i in range(len(t) - P.K + 1)] if len(t) >= P.K else [chained(*t)] if t else []
    seen, items, out = {}, [], ""
    for pos, h in enumerate(kmers):
        seen[h] = seen.get(h, 0) + 1
        items.append((chained(h, (seen[h], "int")), pos))
    for m in range(P.M if items else 0):
        least = [None, None]
        for item, pos in items:
            v = chained(item, (m, "int"))
            placed = (v >> P.POSITION_BITS << P.POSITION_BITS) | pos
            if least[v & 1] is None or placed < least[v & 1]:
                least[v & 1] = placed
        pair = sorted((x % 2**P.POSITION_BITS, x >> P.POSITION_BITS) for x in least if x is not None)
        out += f"{chained(*(h for _, h in pair), (0, 'int')) % 2**32:08x}"
    return out


def test_fingerprints_equal_plain_computation(spark):
    r = random.Random(4)
    texts = ["", None, "one", "one two", "a b c", "same " * 40, "w" * 50 + " ä ö \t ü", *(" ".join(f"v{r.randrange(40)}" for _ in range(r.randrange(3, 150))) for _ in range(12))]
    got = {x.doc_id: x for x in P.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    edited = lambda a, b: a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    for i, t in enumerate(texts):
        assert got[i].fingerprint == plain_fingerprint(t or "")
        assert got[i].edited_fingerprint == plain_fingerprint(edited(t or "", texts[i - 1] or ""))


def test_fingerprints_follow_order_and_edit_distance(spark):
    r = random.Random(6)
    base = [f"v{r.randrange(5000)}" for _ in range(300)]
    moved = base[150:] + base[:150]
    some = [w if r.random() > 0.02 else "new" for w in base]
    many = [w if r.random() > 0.2 else "new" for w in base]
    rows = list(enumerate(" ".join(x) for x in (base, some, many, moved)))
    got = {x.doc_id: x.fingerprint for x in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = {i: np.mean([got[0][k : k + 8] == got[i][k : k + 8] for k in range(0, 8 * P.M, 8)]) for i in got}
    # two halves that change places keep nearly all k-mers, yet about half of the ordered pairs go
    assert like[0] == 1 and like[1] > like[2] and like[1] > like[3] and like[3] < 0.85


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(4, w0=0.3, w=rng.normal(size=9), v=rng.normal(size=(9, 3)))
    x = rng.normal(size=(5, 9))
    pairs = [sum(row[i] * row[j] * (model.v[i] @ model.v[j]) for i in range(9) for j in range(i)) for row in x]
    assert np.allclose(model.logit(x), 0.3 + x @ model.w + pairs)


def test_quality_of_odd_rows(spark):
    rows = [(" ".join(f"good{(i + k) % 7}" for k in range(20)), 100, 1) for i in range(40)] + [(" ".join(f"bad{(i + k) % 7}" for k in range(20)), 100, 0) for i in range(40)]
    model = quality.train(rows, buckets=256, epochs=10)
    table = spark.createDataFrame([(1, "good1 good2 good3", 17), (2, "bad1 bad2 bad3", None), (3, None, None), (4, "", 0), (5, "good1 " * 20000, 120000), (None, "bad4", 4), (1, "good1 good2 good3", 17)], "doc_id long, text string, n_chars long")
    got = quality.score_quality(table, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and by[1] > 0.5 > by[2] and by[5] > 0.5 > by[None]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in quality.score_quality(table, quality.train([("a", 1, 1)])).collect()} == {1.0}
