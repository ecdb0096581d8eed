"""Yinyang rounds against comparing every pair, on ties, copies and odd rows."""

from hashlib import sha256

import numpy as np
import pytest

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import clustering as C  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def plain(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    c = [x for _, x in sorted((sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]]
    for n in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in kept]
        if n < rounds:
            for j in range(len(c)):
                mine = [x for (_, x), (_, at) in zip(kept, best) if at == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    inertia = {j: sum(d for d, at in best if at == j) for j in range(len(c))}
    text = lambda j: sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), text(j)) for (i, _), (d, j) in zip(kept, best)), key=str)


def run(spark, rows):
    table = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.digests(spark, table).collect()), key=str)


def test_blobs_copies_ties_and_odd_rows(spark):
    r = np.random.default_rng(4)
    middles = r.normal(0, 0.4, (12, 64))
    rows = [(i, (middles[i % 12] + r.normal(0, 0.15, 64)).tolist()) for i in range(400)]
    rows += [(1000 + i, middles[0].tolist()) for i in range(300)]  # many copies, several of them first centroids
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(60)]  # whole ties
    rows += [(None, rows[3][1]), (7, rows[9][1]), (2**60 + 1, rows[5][1]), (1, None), (2, [0.1] * 63), (3, [0.1] * 65), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("inf")] + [0.1] * 63), (8, [])]
    assert run(spark, rows) == plain(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [i / 7] * 64) for i in range(5)] + [(9, [i / 3 for i in range(64)])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [(1, None), (2, [0.5])]) == [] and run(spark, rows[:1]) == plain(rows[:1])


def test_bounds_hold_and_save_distances():
    r = np.random.default_rng(8)
    x = np.concatenate([r.integers(-40, 40, (1500, 64)) + 300 * r.integers(-1, 2, (1, 64)) for _ in range(8)])
    c = x[r.choice(len(x), 40, replace=False)].astype(np.int64)
    group = C.groups_of(c)
    assert group.max() + 1 <= 4 and len(group) == 40
    at, d2, upper, lower = C.start(x, c, group)
    scanned = 0
    for _ in range(6):
        new = np.array([np.floor(x[at == j].mean(axis=0)) if (at == j).any() else c[j] for j in range(40)]).astype(np.int64)
        moved = np.sqrt(C.squared(new, c).astype(float)) * (1 + C.EPS)
        c = new
        at, upper, lower, n = C.step(x, at, upper, lower, c, moved, group)
        scanned += n
        every = np.stack([C.squared(x, row) for row in c], axis=1)
        assert (at == every.argmin(axis=1)).all()
        true = np.sqrt(every.astype(float))
        assert (upper >= true[np.arange(len(x)), at]).all()
        true[np.arange(len(x)), at] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= true[:, group == g].min(axis=1)).all()
    assert scanned < 0.5 * 6 * len(x) * 40


def test_large_components(spark):
    rows = [(i, [float(400_000 + 1000 * (i % 7) + i)] * 64) for i in range(50)]
    assert run(spark, rows) == plain(rows)
