"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, each window of a document that has as many words as the item is a candidate; a document with fewer words
that can still reach the similarity is one as a whole. Windows
without any of the items' shingles have similarity 0 and are passed over; the others get a 64-bit SimHash of their
shingles. Fingerprints are split into 8 blocks; a window and an item within RADIUS bits differ by two bits at most in some
block, so looking every block up with two bits' tolerance finds all of them. What is found is verified by exact weighted-shingle
similarity (shingles of five words, A-Z lower-cased, weighted by occurrences): sum of minima over sum of maxima, 0.8 or more.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, each held against all rows. Null, empty or blank texts and items: no match. An item of
fewer than five words is one shingle. Repeated items and rows: each has its own matches. Ties: the earliest window.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import texts

SHINGLE = 5
BLOCKS, TOLERANCE = 8, 2
RADIUS = BLOCKS * (TOLERANCE + 1) - 1
BLOCK_WORDS = 1_000_000  # words of the benchmark that go to the tasks at a time


def simhash(shingles: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=-1)
    major = 2 * bits.sum(1, dtype=np.int32) > shingles.shape[1]
    return np.packbits(major, axis=-1).reshape(len(shingles), 8).view(np.uint64).ravel()


class Items:
    """A block of the benchmark, prepared for look-up."""

    def __init__(self, rows: list[tuple[int, str]], percent: int):
        self.percent = percent
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in rows:
            raw, starts, ends, _ = W.tokenise([(text or "").encode("utf-8", "replace")], lower=True)
            n = len(starts)
            if n:
                by_size[n].append((item, W.windows(W.hashes(raw, starts, ends), min(SHINGLE, n))))
        byte = np.arange(256, dtype=np.uint8)
        self.classes = []
        for n, items in sorted(by_size.items()):
            prints = simhash(np.stack([g for _, g in items]))
            own = prints.view(np.uint8).reshape(-1, 8)
            near = np.stack([np.bitwise_count(byte[:, None] ^ own[None, :, b]) <= TOLERANCE for b in range(BLOCKS)])
            self.classes.append((n, [i for i, _ in items], prints, near, [Counter(g.tolist()) for _, g in items], np.unique(np.concatenate([g for _, g in items]))))
        sizes = {min(SHINGLE, c[0]) for c in self.classes}
        self.known = {size: np.unique(np.concatenate([c[5] for c in self.classes if min(SHINGLE, c[0]) == size])) for size in sizes}

    def find(self, parts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of each text's best window for each item."""
        raw, starts, ends, first = W.tokenise(parts, lower=True)
        if not len(starts):
            return []
        h = W.hashes(raw, starts, ends)
        grams = {size: W.windows(h, size) for size in self.known}
        hits_of = {size: self._hits(g, self.known[size]) for size, g in grams.items()}
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n, ids, prints, near, counts, known in self.classes:
            size = min(SHINGLE, n)
            g, per = grams[size], n - size + 1
            hits = hits_of[size]
            if not len(hits):
                continue
            at = np.minimum(np.searchsorted(known, g[hits]), len(known) - 1)
            hits = hits[known[at] == g[hits]]
            for t, both, top in self._short(n, per, g, hits, first, prints, counts):
                for c, k in both:
                    best[t, ids[c]] = min(best.get((t, ids[c]), (0.0, 0)), (-k / (per + top - k), 0))
            if len(h) < n:
                continue
            # every window of n words that holds a hit
            s = np.unique((hits[:, None] - np.arange(per)).ravel())
            s = s[(s >= 0) & (s <= len(h) - n)]
            text = np.searchsorted(first, s, side="right") - 1
            inside = s + n <= first[text + 1]
            s, text = s[inside], text[inside]
            for lo in range(0, len(s), 2048):
                at = s[lo : lo + 2048]
                fp = simhash(g[at[:, None] + np.arange(per)])
                fb = fp.view(np.uint8).reshape(-1, 8)
                found = near[0][fb[:, 0]]
                for b in range(1, BLOCKS):
                    found = found | near[b][fb[:, b]]
                rows, cols = np.nonzero(found)
                close = np.bitwise_count(fp[rows] ^ prints[cols]) <= RADIUS
                for r, c in zip(rows[close], cols[close], strict=True):
                    want, both = counts[c], 0
                    for x, k in Counter(g[at[r] : at[r] + per].tolist()).items():
                        both += min(k, want.get(x, 0))
                    if 100 * both >= self.percent * (2 * per - both):
                        t = int(text[lo + r])
                        key, value = (t, ids[c]), (-both / (2 * per - both), int(at[r] - first[t]))
                        if key not in best or value < best[key]:
                            best[key] = value
        return [(t, item, -v[0], v[1]) for (t, item), v in sorted(best.items())]

    def _short(self, n: int, per: int, g: np.ndarray, hits: np.ndarray, first: np.ndarray, prints: np.ndarray, counts: list[Counter]) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
        """(text, (item, common shingles), the text's shingles) of texts shorter than items of n words that are near to one as wholes."""
        own = np.diff(first) - (n - per)  # shingles of each text
        maybe = np.flatnonzero((own > 0) & (own < per) & (100 * own >= self.percent * per))
        for t in maybe.tolist():
            m, lo = int(own[t]), int(first[t])
            # as many of its shingles as the similarity takes must be in some item
            if 100 * (np.searchsorted(hits, lo + m) - np.searchsorted(hits, lo)) < self.percent * per:
                continue
            whole, both = g[lo : lo + m], []
            held = Counter(whole.tolist())
            for c in np.flatnonzero(np.bitwise_count(simhash(whole[None])[0] ^ prints) <= RADIUS).tolist():
                k = sum(min(x, counts[c].get(s, 0)) for s, x in held.items())
                if 100 * k >= self.percent * (per + m - k):
                    both.append((c, k))
            yield t, both, m

    @staticmethod
    def _hits(g: np.ndarray, known: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 16, bool)
        table[known & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(table[g & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)
        return maybe[known[at] == g[maybe]]


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of some BLOCK_WORDS words each, one block in the driver at a time."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    n = int(total // BLOCK_WORDS) + 1
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, similarity, start): for each document and item in it, the best window's similarity and first word."""
    out = None
    for items in benchmark_blocks(benchmark):

        def run(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            lookup = Items(items, percent)
            for pdf in batches:
                ids, rows = pdf["doc_id"].tolist(), pdf["text"].tolist()
                for at, parts in W.chunks(rows):
                    found = [(ids[at + t], item, v, s) for t, item, v, s in lookup.find(parts)]
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "start"])

        part = texts(docs).mapInPandas(run, "doc_id long, item_id long, similarity double, start long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found. No row is shuffled."""
    for items in benchmark_blocks(benchmark):

        def run(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            lookup = Items(items, percent)
            for pdf in batches:
                bad: set[int] = set()
                for at, parts in W.chunks(pdf["text"].tolist()):
                    bad |= {at + t for t, _, _, _ in lookup.find(parts)}
                yield pdf[[i not in bad for i in range(len(pdf))]]

        docs = docs.mapInPandas(run, docs.schema)
    return docs


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
ds as (select doc_id, len(w) as n, p, array_to_string(w[p + 1:p + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as p from dw where len(w) >= 5)),
it as (select item_id, n, g, count(*) as k from (select item_id, len(w) as n, array_to_string(w[p + 1:p + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as p from iw where len(w) >= 5)) group by all),
c as (select distinct doc_id, item_id, m, unnest(range(greatest(0, p - m + 5), least(p, n - m) + 1)) as start from (select ds.doc_id, it.item_id, ds.p, ds.n, it.n as m from ds join it on ds.g = it.g)),
x as (select c.doc_id, c.item_id, c.m, c.start, ds.g, count(*) as k from c join ds on c.doc_id = ds.doc_id and ds.p between c.start and c.start + c.m - 5 group by all),
v as (select x.doc_id, x.item_id, x.m, x.start, sum(least(x.k, it.k)) as common from x join it on x.item_id = it.item_id and x.g = it.g group by all),
r as (select *, row_number() over (partition by doc_id, item_id order by common desc, start) as rn from v where 100 * common >= 80 * (2 * (m - 4) - common))
select doc_id, item_id, cast(common as double) / (2 * (m - 4) - common) as similarity, start from r where rn = 1
"""
