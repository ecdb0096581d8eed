"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import decontamination, fingerprints, licenses, mixing, near_duplicates, packing, pii, quality, substrings, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bucket int, rep long, tokens string, spans string"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


def table(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, 1, 2, 3, "x", "y") for i, t, s in rows], SCHEMA)


def odd(spark):
    return table(spark, (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (5, "same text twice over here", "b"), (5, "same text twice over here", "b"), (6, LONG, "b"), (7, LONG, None), (None, "no id at all", "c"))


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, None), (3, "")], "item_id long, text string")


def operators(spark):
    rows = [("idiot " + f"word{i} thing", 1) for i in range(12)] + [(f"plain w{i} text here", 0) for i in range(12)]
    tox, qual = toxicity.train(rows), quality.train([(t, len(t), y) for t, y in rows], buckets=64, epochs=2)
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, tox), "fingerprints": fingerprints.fingerprints, "licenses": licenses.scan_licenses, "pii": pii.find_pii, "packing": packing.pack, "substrings": substrings.remove_repeats,
        "mixing": mixing.mix_counts, "mix": mixing.mix, "mix_documents": mixing.mix_documents, "decontamination": lambda d: decontamination.find_leaks(d, bench(spark)), "clean": lambda d: decontamination.drop_contaminated(d, bench(spark)), "near": near_duplicates.near_duplicates, "quality": lambda d: quality.score_quality(d, qual),
    }


PER_ROW = ("toxicity", "fingerprints", "licenses", "pii", "substrings", "mixing", "near", "quality")


@pytest.mark.parametrize("name", ["toxicity", "fingerprints", "licenses", "pii", "packing", "substrings", "mixing", "mix", "mix_documents", "decontamination", "clean", "near", "quality"])
def test_odd_rows_and_no_rows(spark, name):
    run = operators(spark)[name]
    got = run(odd(spark)).collect()
    if name in PER_ROW:
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (True, 5), (True, 6), (True, 7)]
    if name == "near":
        by = {r.doc_id: r for r in got}
        assert by[7].component_id == 6 and not by[7].kept and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1
    if name == "substrings":
        by = {r.doc_id: r for r in got}
        assert by[7].n_removed == by[7].n_words == 30000 and by[5].n_removed == 0 and by[1].n_words == 0
    if name == "decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(6, 1), (7, 1)}
    if name == "clean":
        assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, None}
    assert run(odd(spark).limit(0)).count() == 0
