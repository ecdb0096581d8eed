"""The manifest against a plain computation, over many ranges and odd rows; the stack against whole levels."""

import zlib
from hashlib import sha256

import pytest

pytest.importorskip("breakweave.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from breakweave.llm import manifest as M  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, idx long, proof string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 7, "clash") for r in rows], SCHEMA)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree(values):
    """Root and, for each value, its siblings by level."""
    paths, at, level = [[] for _ in values], list(range(len(values))), list(values)
    while len(level) > 1:
        for i, p in enumerate(paths):
            j = at[i] - at[i] % 3
            p.append((level[j : at[i]], level[at[i] + 1 : j + 3]))
            at[i] //= 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[1] is None else "1" + r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=str.encode)
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (_, _, digest, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + above[k]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf(*r[:4], r[4].replace("\n", "")) if even and r[4] is not None else digest
            for left, right in path:
                acc = h(*left, acc, *right)
            out.append((r[0], digest, trees[g][0], root, h(*(d for left, right in path for d in left + right)), acc, acc == root))
    return sorted(out, key=str)


def many():
    rows = [(i * 7 % 3001, f"s{min(i % 4, 2)}", "en", i, f"text {i}\n{'é' * (i % 5)}\n") for i in range(2000)]
    return rows + [(None, "s0", None, None, None), (None, "s0", "en", 1, ""), (None, None, "en", 1, "a\nb"), (5, None, "fr", 0, ""), (2**60 + 1, "s0", "en", 3, "x\ny"), (-4, "é", "en", 3, "x\ny"), (11, "s1", "en", 9, "twin\n"), (11, "s1", "en", 9, "twin\n"), (11, "s1", "de", 9, "other\n")]


@pytest.mark.parametrize("range_rows", [60, 50_000])
def test_manifest_equals_a_plain_one(spark, range_rows, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(M, "BLOCK_ROWS", 100)
    rows = many()
    docs = table(spark, rows)
    got = M.manifest(spark, docs, range_rows, shown=M.tampered(docs)).withColumn("folded_root", M.folded(F.col("shown"), F.col("proof")))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(M.siblings(F.col("proof")), 256), "folded_root", F.col("folded_root") == F.col("root"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_tables(spark, n):
    rows = [(i, "only", "en", 1, "line\nline" * (i % 3)) for i in range(n)]
    assert sorted((tuple(r) for r in M.checked(spark, table(spark, rows)).collect()), key=str) == plain(rows)


def test_many_sources_and_no_rows(spark):
    rows = [(i, f"site{i % 90}", "en", 1, f"t{i}\n") for i in range(200)]
    assert sorted((tuple(r) for r in M.checked(spark, table(spark, rows)).collect()), key=str) == plain(rows)
    assert M.checked(spark, table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 27, 100, 730, 2188])
def test_stacks_cut_anywhere_merge_to_the_same_root(n):
    values = [h(str(i)) for i in range(n)]
    cuts = sorted({0, n, n // 3, n // 2 + 1, n - 1, min(n, 40)})
    peaks, made = [], []
    for a, b in zip(cuts, cuts[1:]):
        stack = M.Range(n)
        for i in range(a, b):
            stack.push(0, i, values[i])
        peaks += stack.close()
        made += stack.made
    assert len(peaks) <= 4 * len(cuts) * (M.height(n) + 1)
    last = M.Range(n)
    for level, i, v in sorted(peaks, key=lambda x: (x[1] * 3 ** x[0], x[0])):
        last.push(level, i, v)
    assert last.close() == [(M.height(n), 0, plain_tree(values)[0])]
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    want = {(k, i, v) for k in range(M.STRIDE, len(levels), M.STRIDE) for i, v in enumerate(levels[k])}
    assert set(made + last.made) == want and len(made + last.made) == len(want)
