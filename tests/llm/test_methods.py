"""Operators against brute force on small fixtures."""

import hashlib
import random
import re

import pytest

pytest.importorskip("breakweave.llm.queries")

import numpy as np  # noqa: E402

from breakweave.llm import decontamination, fingerprints, licenses, mixing, near_duplicates, packing, pii, quality, substrings, toxicity  # noqa: E402
from breakweave.llm import words as W  # noqa: E402


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def drawn(n, seed=1, vocabulary=300, longest=120):
    r = random.Random(seed)
    return [" ".join(f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(1, longest))) for _ in range(n)]


def near_copies(seed=2):
    r, out = random.Random(seed), drawn(30, seed)
    for t in drawn(12, seed + 1, longest=90):
        for k in (0, 1, 3, 8):
            w = t.split()
            for _ in range(k):
                w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
            out.append(" ".join(w))
    return out


def test_words():
    t = "a  bb\tccc d\n".encode()
    raw, starts, ends, first = W.tokenise([t, b"", b"x"])
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a", "bb", "ccc d", "x"] and first.tolist() == [0, 3, 3, 4]
    h = W.hashes(*W.tokenise([b"a b a b a b a"])[:3])
    assert len(set(W.windows(h, 3).tolist())) == 2 and len(W.windows(h, 9)) == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    sets = [{tuple(t.lower().split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for t in texts]
    top = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if top[i] != top[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    lo, hi = sorted((top[i], top[j]))
                    top = [lo if x == hi else x for x in top]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs(spark, texts), small=6).collect()}
    assert got == {i: (len(s), top[i], top[i] == i) for i, s in enumerate(sets)}


def test_substrings_equal_brute_force(spark):
    r, texts = random.Random(5), drawn(25, 5, 4, 90)
    shared = " ".join(f"p{i}" for i in range(35))
    texts += [f"x{i} {shared} y{i}" for i in range(6)] + [texts[0], " ".join(["rep"] * 60)]
    r.shuffle(texts)
    seen, gone = set(), [set() for _ in texts]
    for d, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[d].update(range(s, s + 20))
            seen.add(key)
    want = {d: (len(t.split()), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(t.split()) if i not in gone[d]).encode()).hexdigest()) for d, t in enumerate(texts)}
    for share, least in ((None, 64), (1e-3, 2)):  # with and without windows dealt out as frequent
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(docs(spark, texts), share=share, least=least).collect()}
        assert got == want


def test_fingerprints_follow_edits(spark):
    texts = [*drawn(12, 8, 5000, 200), "x"]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        after, cut = texts[(i - 1) % len(texts)], len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        same = lambda a, b: np.mean([a[k : k + 8] == b[k : k + 8] for k in range(0, 8 * fingerprints.M, 8)])
        assert got[i].near_next == same(got[i].fingerprint, got[(i - 1) % len(texts)].fingerprint)
    assert len({r.fingerprint for r in got.values()}) == len(texts)


def test_mixing_meets_targets(spark):
    table = docs(spark, drawn(60, 9))
    rows = mixing.mix_counts(table, block=16).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in range(3):
        mine = [r for r in rows if r["doc_id"] % 3 == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])
    for form in (mixing.mix, mixing.mix_documents):
        taken = {}
        for r in form(table, block=16).collect():
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(re.findall(r"[^ \t-\r]+", r["text"]))
        assert taken == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_slots_visit_every_block_once_a_pass(spark):
    targets = mixing.source_targets(mixing.sized(docs(spark, drawn(60, 9))), 16)
    seen = {}
    for r in mixing.draw_slots(targets, 16).orderBy("slot").collect():
        seen.setdefault((r["source"], r["pass"]), []).append(r["block"])
    for r in targets.collect():
        first = seen[r["source"], 0]
        assert sorted(first) == list(range(r["blocks"])) or r["passes"] == 0
        assert len({(b - a) % r["blocks"] for a, b in zip(first, first[1:])}) > len(first) // 3  # no lattice


def test_mixed_documents_are_whole_where_a_pass_is(spark):
    twins = "same words in two rows of one source " * 9
    rows = [(i, t, "s1") for i, t in enumerate(drawn(40, 19))] + [(50, twins, "s1"), (50, twins, "s1"), (None, "no id and no source", None)]
    table = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mixed, counts = mixing.mix_documents(table, block=16).collect(), mixing.mix_counts(table, block=16).collect()
    assert sum(r.text in {t for _, t, _ in rows} for r in mixed) > 0.5 * len(mixed)
    for i in (50, None):
        assert sum(len(r.text.split()) for r in mixed if r.doc_id == i) == sum(r.taken for r in counts if r.doc_id == i) > 0


def test_packing_is_lossless(spark):
    texts = ["a b  c\n\nd", "", "naïve ünï 漢字 " * 300, *drawn(20, 3)]
    packed = packing.pack(docs(spark, texts), length=64)
    back = {}
    for r in packing.unpack(packed).orderBy("doc_id", "part").collect():
        back[r.doc_id] = back.get(r.doc_id, "") + r.text
    assert {i: t.encode("latin-1").decode() for i, t in back.items()} == dict(enumerate(texts))
    for r in packed.collect():
        assert r.cu_seqlens[-1] == r.n_tokens <= 64 and len(r.ids) == 128 and r.position_resets == r.cu_seqlens[:-1]


def test_best_fit_equals_plain_search():
    r = random.Random(4)
    lengths, left = [r.randrange(1, 101) for _ in range(800)], []
    for x in sorted(lengths, reverse=True):
        fits = [(c, k) for k, c in enumerate(left) if c >= x]
        if fits:
            left[min(fits)[1]] -= x
        else:
            left.append(100 - x)
    rows = packing.best_fit_decreasing(lengths, 100)
    assert len(rows) == len(left) and sorted(i for x in rows for i in x) == list(range(800))


def test_decontamination_equals_brute_force(spark):
    items = drawn(8, 11, 4000, 60)
    texts = drawn(10, 12, 4000, 150) + [f"start here {t} and the end" for t in items]
    for t in items[:4]:
        w = t.split()
        w[len(w) // 2] = "other"
        texts.append("before " + " ".join(w))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")

    def grams(w):
        n = min(5, len(w))
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for k, item in enumerate(items):
            g = grams(item.split())
            n, best = len(item.split()), 0
            for s in range(len(w) - n + 1):
                x = grams(w[s : s + n])
                both = sum(min(x.count(e), g.count(e)) for e in set(x))
                if 100 * both >= 80 * (2 * len(g) - both):
                    best = max(best, both / (2 * len(g) - both))
            if best:
                want[d, k] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    assert got == want and len(got) >= 8


def plain_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.BASE_KINDS.index(s[2]), s[1]))


def test_pii_base_and_added():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice("a1.@-+ 2(4)0%") for _ in range(r.randrange(1, 60)))
        assert pii.base_spans(t) == plain_spans(t)
    trees = pii.fit_pii()
    t = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and order 12345678901 of 2 or a@b.co'
    base = pii.base_spans(t)
    assert [t[a:b] for a, b, _ in pii.added_spans(t, base, trees)] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"] and [s[2] for s in base] == ["email"]
    held = pii.drawn_sentences(900, 99)
    x, y = np.array([pii.features(t, a, b, k) for t, k, a, b, _ in held]), np.array([h[4] for h in held])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_licenses():
    ids = licenses.SENTENCES
    text = "Intro.\n" + "\n".join(s for i, s in ids if i in ("mit-grant", "mit-include", "as-is")) + "\nAll rights reserved."
    known = {s: i for i, s in ids}
    found = licenses.sentence_ids(text, known, 2000, re.compile("permission|rights|reserved|warranty", re.I))
    assert [x[0] for x in licenses.match_rules(found)] == ["MIT", "all-rights-reserved"]


def test_classifiers_on_held_out_rows(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}" for _ in range(60)]
        if i % 4 == 0:
            words[r.randrange(60)] = r.choice(("zagwort", "blimfex", "quorvid"))
        rows.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.train(rows[:400])
    scores = [x.score for x in toxicity.score_toxicity(docs(spark, [t for t, _ in rows[400:]]), model).orderBy("doc_id").collect()]
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(scores, rows[400:])]) > 0.9
    rows = [((t.upper() + "!!" if i % 3 == 0 else t), len(t), int(i % 3 != 0)) for i, (t, _) in enumerate(rows)]
    fm = quality.train(rows[:400], buckets=256)
    got = [x.score for x in quality.score_quality(docs(spark, [t for t, _, _ in rows[400:]]), fm).orderBy("doc_id").collect()]
    assert np.mean([(s >= 0.5) == y for s, (_, _, y) in zip(got, rows[400:])]) > 0.95
