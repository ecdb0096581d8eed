"""Substring dedup by level-wise doubling of repeated word windows.

Levels of 10 and 20 words. A 20-word window is stood for by the 10-word window in it with the smallest hash; equal windows choose alike, so a
window can only be repeated if its 10-word window is. Those that are repeated are extended to 20 words, and none survives beyond. Neighbouring
20-word windows that share their 10-word window form one segment. Equal segments are settled as wholes: all but the first are covered. Only
where different segments share a 10-word window are their 20-word windows compared one by one. (A level of 5 words below would save nothing:
four fifths of the segments of the check tables are repeated at that length.)

The level groups by the hash of ten words, after equal segments of one input block have been merged. 10-word windows so frequent that
they would be more than a tenth of a mean partition (at most 1 / share of them exist) are known to be repeated, and are dealt out by segment.
Segments are equal by 128 bits, single windows too.

Null, empty or blank text: no words. Fewer words than a window: nothing is removed. Every row is an occurrence of its own,
whatever its doc_id: rows that share one are told apart by a hash of their text, in whose order they come, and of rows alike in both all but
one are covered whole. A null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, texts, told_apart

SHORT, FULL = 10, 20
FIRST = -(2**63)


def segments(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text index, first and last window start (in words of the text), and the hashes of the 10 words and of the whole segment."""
    raw, starts, ends, first = W.tokenise(parts)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(starts) < FULL:
        return empty
    h = W.hashes(raw, starts, ends)
    short = W.windows(h, SHORT)
    low = W.sliding_min(short, FULL - SHORT + 1)  # one for each 20-word window
    owner = np.repeat(np.arange(len(parts)), np.diff(first))[: len(low)]
    s = np.flatnonzero(np.arange(len(low)) + FULL <= first[owner + 1])
    if not len(s):
        return empty
    q, text = low[s], owner[s]
    lo = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1] + 1)]))
    hi = np.append(lo[1:], len(s)) - 1
    full = W.windows(h, FULL)
    # a segment's words are those of its first and last window, a distance apart of less than a window
    whole = W.join(W.join(full[s[lo]], full[s[hi]]), W.mix((s[hi] - s[lo]).astype(np.uint64)))
    begin = first[text[lo]]
    return text[lo], s[lo] - begin, s[hi] - begin, short[q[lo]], whole


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of some most rows at a time, with doc_id and tie in place of the text index."""
    held, size = [], 0
    for pdf in batches:
        ids, ties = pdf["doc_id"].to_numpy(np.int64), pdf["tie"].to_numpy(np.int64)
        rows = pdf["text"].tolist()
        for at, parts in W.chunks(rows):
            text, *rest = segments(parts)
            held.append((ids[at + text], ties[at + text], *rest))
            size += len(text)
            if size >= most:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def frequent(docs: DataFrame, scratch: Scratch, share: float, most: int, least: int = 64) -> np.ndarray:
    """Hashes of the 10-word windows that stand for over a share of all segments; none above twice the share is missed.

    A window above the share overall is above it in some block. At most 1 / share windows are returned.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, short, _ in _blocks(batches, most):
            yield pd.DataFrame({"total": [True], "h": [0], "n": [len(short)]})
            short = np.sort(short.view(np.int64))
            at = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
            n = np.diff(np.append(at, len(short)))
            big = n >= max(min(4, least), share * len(short))
            yield pd.DataFrame({"total": False, "h": short[at[big]], "n": n[big]})

    found = scratch.save(docs.mapInPandas(count, "total boolean, h long, n long").groupBy("total", "h").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("total").agg(F.sum("n")).first()[0] or 0
    kept = found.where(~F.col("total") & (F.col("n") >= max(float(least), share * total))).select("h").collect()
    return np.sort(np.array([r.h for r in kept], dtype=np.int64))


def merged_segments(docs: DataFrame, often: np.ndarray, most: int) -> DataFrame:
    """Segments of all documents: (doc_id, tie, at, key, whole, kind); at is lo << 8 | distance of the last window from lo.

    kind 0: to be counted by its 10-word window; 1: that window is known as repeated; 2: an equal segment came before it in its block, so it is settled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, tie, lo, hi, short, whole in _blocks(batches, most):
            order = np.lexsort((lo, tie, doc, whole, short))
            doc, tie, lo, hi, short, whole = (x[order] for x in (doc, tie, lo, hi, short, whole))
            again = np.zeros(len(doc), bool)
            again[1:] = (short[1:] == short[:-1]) & (whole[1:] == whole[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))
            again &= (doc != doc[head]) | (tie != tie[head]) | (lo != lo[head])
            kind = np.isin(short.view(np.int64), often).astype(np.int8)
            key = np.where(kind == 0, short, W.join(short, whole))
            kind[again] = 2
            key = np.where(again, W.mix(doc.view(np.uint64) + W.mix(lo.astype(np.uint64) + W.mix(tie.view(np.uint64)))), key)
            yield pd.DataFrame({"doc_id": doc, "tie": tie, "at": lo << 8 | hi - lo, "key": key.view(np.int64), "whole": whole.view(np.int64), "kind": kind})

    return docs.mapInPandas(run, "doc_id long, tie long, at long, key long, whole long, kind byte")


def settle(segs: DataFrame) -> DataFrame:
    """(doc_id, tie, work) of the segments that stay candidates: covered ones, and those whose windows must be compared; work is at << 1 | covered."""
    ten = Window.partitionBy("key").orderBy("whole", "doc_id", "tie", "at")
    everything = ten.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = segs.withColumn("n", F.count(F.lit(1)).over(everything)).withColumn("kinds", F.when(F.first("whole").over(everything) == F.last("whole").over(everything), 1).otherwise(2))
    same = Window.partitionBy("key", "whole").orderBy("doc_id", "tie", "at")
    rows = rows.withColumn("f", F.first(F.struct("doc_id", "tie", "at")).over(same)).where("kind > 0 or n > 1")
    rows = rows.withColumn("covered", F.expr("kind = 2 or doc_id <> f.doc_id or tie <> f.tie or at <> f.at"))
    rows = rows.where("covered or kinds > 1 or kind = 1")
    return rows.select("doc_id", "tie", (F.shiftleft("at", 1) + F.col("covered").cast("long")).alias("work"))


def runs_of(lo: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the runs [lo, upto) into those that don't touch."""
    order = np.argsort(lo, kind="stable")
    lo, upto = lo[order], np.maximum.accumulate(upto[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > upto[:-1]])) if len(lo) else np.zeros(0, np.int64)
    return lo[new], np.append(upto[new[1:] - 1], upto[-1:])


def kept_words(text: str, lo: np.ndarray, upto: np.ndarray) -> bytes:
    """The words outside the runs, joined by one space."""
    ws = text.encode("utf-8", "replace").split()
    edges = [0, *np.column_stack([lo, upto]).ravel().tolist(), len(ws)]
    return b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in ws[a:b]])


def looked_at(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is known of each row once its settled runs are applied: the digest where nothing is left to compare, else its text, runs and 128-bit windows."""
    out = {k: [] for k in ("doc_id", "tie", "text", "n_words", "runs", "a", "b", "s", "n_removed", "kept_sha256")}
    for doc, tie, text, work, copy in zip(pdf["doc_id"], pdf["tie"], pdf["text"], pdf["work"], pdf["copy"], strict=True):
        work = np.asarray(work if work is not None else (), dtype=np.int64)
        at, covered = work >> 1, (work & 1).astype(bool)
        lo, more, n_words = at >> 8, at & 255, len(text.encode("utf-8", "replace").split())
        left, upto = runs_of(lo[covered], (lo + more + FULL)[covered])
        if copy > 1 and n_words >= FULL:
            left, upto, covered = np.zeros(1, np.int64), np.full(1, n_words), np.ones(len(covered), bool)
        todo = not covered.all()
        a = b = s = np.zeros(0, np.int64)
        if todo:
            h = W.hashes(*W.tokenise([text.encode("utf-8", "replace")])[:3])
            s = np.concatenate([np.arange(x, x + m + 1) for x, m in zip(lo[~covered], more[~covered], strict=True)])
            a, b = W.windows(h, FULL)[s].view(np.int64), W.windows(W.mix(h + np.uint64(1)), FULL)[s].view(np.int64)
        out["doc_id"].append(doc)
        out["tie"].append(tie)
        out["text"].append(text if todo else None)
        out["n_words"].append(n_words)
        out["runs"].append(np.column_stack([left, upto]).ravel() if todo else None)
        for k, v in (("a", a), ("b", b), ("s", s)):
            out[k].append(v if todo else None)
        out["n_removed"].append(int((upto - left).sum()))
        out["kept_sha256"].append(None if todo else hashlib.sha256(kept_words(text, left, upto)).hexdigest())
    return pd.DataFrame(out)


LOOKED = "doc_id long, tie long, text string, n_words long, runs array<long>, a array<long>, b array<long>, s array<long>, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, share: float | None = None, most: int = 400_000, least: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    share = share or 1 / max(2000, 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = told_apart(texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(FIRST))))
    work = settle(merged_segments(rows, frequent(rows, scratch, share, most, least), most))
    work = scratch.save(work, "work").groupBy("doc_id", "tie").agg(F.collect_list("work").alias("work"))
    # of rows alike in id and text the later ones are repeats from end to end; ties are 0 where an id is in one row alone
    copies = rows.where("tie <> 0").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    todo = rows.join(work, ["doc_id", "tie"], "left").withColumn("copy", F.lit(1))
    if not copies.isEmpty():
        todo = todo.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("doc_id")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                yield looked_at(pdf.iloc[lo : lo + 256])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            removed, sha = [], []
            for text, runs, later in zip(pdf["text"], pdf["runs"], pdf["later"], strict=True):
                runs, later = np.asarray(runs, np.int64), np.asarray(later if later is not None else (), np.int64)
                left, upto = runs_of(np.append(runs[::2], later), np.append(runs[1::2], later + FULL))
                removed.append(int((upto - left).sum()))
                sha.append(hashlib.sha256(kept_words(text, left, upto)).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": pdf["n_words"], "n_removed": removed, "kept_sha256": sha})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    looked = scratch.save(todo.mapInPandas(look, LOOKED), "looked")
    done = looked.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    rest = looked.where("kept_sha256 is null")
    wins = rest.select("doc_id", "tie", F.explode(F.arrays_zip("a", "b", "s")).alias("w")).select("doc_id", "tie", "w.a", "w.b", "w.s")
    first = wins.groupBy("a", "b").agg(F.min(F.struct("doc_id", "tie", "s")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "m")
    later = wins.join(first, ["a", "b"]).where("doc_id <> m.doc_id or tie <> m.tie or s <> m.s")
    later = later.groupBy("doc_id", "tie").agg(F.collect_list("s").alias("later"))
    rest = rest.select("doc_id", "tie", "text", "n_words", "runs").join(later, ["doc_id", "tie"], "left").mapInPandas(finish, schema)
    out = done.unionByName(rest)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != FIRST, F.col("doc_id")))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20),
k as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as g from p),
r as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as rn from k),
c as (select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(s, s + 20)) as i from r where rn > 1) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone is null or not list_contains(gone, i)), lambda i: w[i]), ' ')) as kept_sha256
from d left join c on d.doc_id = c.doc_id
"""
