"""Form letters: a large node in which links avoid its least member."""

import random

import pytest

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import near_duplicates  # noqa: E402


def test_pairs_in_a_template_family(spark):
    template = [f"t{i}" for i in range(200)]
    forms = [[f"f{i}x{k}" for k in range(30)] for i in range(60)]
    near = [[*f[:24], *(f"g{i}x{k}" for k in range(6))] for i, f in enumerate(forms) if i >= 20]
    texts = [" ".join(template + f) for f in forms + near]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked == {(i + 20, 60 + i) for i in range(40)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_duplicates.near_duplicates(docs, small=10).collect()}
    assert got == {i: i - 40 if i >= 60 else i for i in range(len(texts))}


def test_star_around_the_largest_id(spark):
    """Copies that are linked with one centre, which has the largest id, and mostly not with each other."""
    r = random.Random(4)
    centre = [f"c{i}" for i in range(300)]
    leaves = []
    for i in range(700):
        at = r.randrange(270)
        leaves.append([*centre[:at], *(f"l{i}x{k}" for k in range(27)), *centre[at + 27 :]])
    texts = [" ".join(w) for w in [*leaves, centre]]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    assert all(100 * len(s & sets[-1]) >= 80 * len(s | sets[-1]) for s in sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.component_id for x in near_duplicates.near_duplicates(docs, small=40).collect()} == {0}
