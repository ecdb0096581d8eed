"""Quality by a factorisation machine.

Features of a text: its hashed lower-cased words (log counts, scaled to unit length), binned structure
statistics and the binned n_chars metadata. The machine adds low-rank interactions of all pairs of
features, computed in linear time as half the difference of the squared sum and the sum of squares.

Null or empty text: no words, statistics of 0. Null n_chars: a bin of its own. Repeated rows: equal
scores. No labelled row of one class: the share of class 1 (1 without any labelled row: nothing is rejected).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

STATS = ("log_chars", "log_words", "mean_word", "upper", "digit", "symbol", "pipe", "non_ascii", "lines", "repeated_lines", "distinct_words", "capitalised", "metadata")


def _classes() -> np.ndarray:
    lut = np.full(256, 5, dtype=np.uint8)  # 5: symbols and control characters
    for lo, hi, k in ((65, 91, 0), (97, 123, 1), (48, 58, 2), (128, 256, 4)):
        lut[lo:hi] = k
    lut[[32, 9, 11, 12, 13]] = 3
    lut[10], lut[ord("|")] = 6, 7
    lut[[ord(c) for c in ".,;:'\"-()"]] = 8
    return lut


CLASSES = _classes()


class WordBuckets(dict):
    """A cache of word to bucket; it is emptied when full, which changes no result."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "replace")) % self.buckets
        return out


def featurise(text: str, n_chars, words_of: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and word vector of one whole text."""
    words = text.lower().split()
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    c = np.bincount(CLASSES[raw], minlength=9)
    n, nw = max(1, len(raw)), max(1, len(words))
    letters = max(1, c[0] + c[1])
    lines = text.split("\n")
    stats = np.array([
        np.log1p(len(text)), np.log1p(len(words)), (n - c[3] - c[6]) / nw, c[0] / letters, c[2] / n, c[5] / n, c[7] / n, c[4] / n,
        c[6] / nw, 1 - len(set(lines)) / len(lines), len(set(words)) / nw, sum(w[0].isupper() for w in text.split()) / nw if words else 0,
        -1.0 if n_chars is None or n_chars != n_chars else np.log1p(max(0.0, float(n_chars))),
    ])
    vec = np.log1p(np.bincount([words_of[w] for w in words], minlength=words_of.buckets)) if words else np.zeros(words_of.buckets)
    norm = np.sqrt((vec * vec).sum())
    return stats, (vec / norm if norm else vec)


@dataclass
class QualityModel:
    buckets: int
    bins: int = 8
    edges: list = field(default_factory=list)
    w0: float = 0.0
    w: np.ndarray = None
    v: np.ndarray = None
    prior: float = 1.0

    def fill(self, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Puts a one-hot block for each statistic after the word buckets of x."""
        rows = np.arange(len(stats))
        for j, edges in enumerate(self.edges):
            x[rows, self.buckets + j * self.bins + np.searchsorted(edges, stats[:, j], side="right")] = 1
        return x

    def empty(self, n: int) -> np.ndarray:
        return np.zeros((n, self.buckets + len(STATS) * self.bins), dtype=np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s * s).sum(1) - ((x * x) @ (self.v * self.v)).sum(1))


def train(rows: Iterable[tuple[str, object, int]], buckets: int = 4096, rank: int = 8, epochs: int = 30, bins: int = 8, seed: int = 7) -> QualityModel:
    """Fits the machine on (text, n_chars, label) rows with Adam on the logistic loss. Of a row only its words' weights stay; whole vectors are made for a batch at a time."""
    cache, stats, words, y = WordBuckets(buckets), [], [], []
    for text, n, label in rows:
        known, vec = featurise(text or "", n, cache)
        at = np.flatnonzero(vec)
        stats.append(known)
        words.append((at.astype(np.int32), vec[at].astype(np.float32)))
        y.append(label)
    y = np.array(y, dtype=np.float32)
    model = QualityModel(buckets, bins, prior=float(y.mean()) if len(y) else 1.0)
    if not len(y) or model.prior in (0.0, 1.0):
        return model
    stats = np.array(stats)
    model.edges = [np.unique(np.quantile(stats[:, j], np.arange(1, bins) / bins)) for j in range(stats.shape[1])]
    width = buckets + len(STATS) * bins
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(width, np.float32), rng.normal(0, 0.005, (width, rank)).astype(np.float32)]
    params[0][:] = np.log(model.prior / (1 - model.prior))
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 128):
            at = order[lo : lo + 128]
            b, v = model.empty(len(at)), params[2]
            for i, k in enumerate(at.tolist()):
                b[i, words[k][0]] = words[k][1]
            model.fill(b, stats[at])
            model.w0, model.w, model.v = float(params[0][0]), params[1], v
            g = (1 / (1 + np.exp(-np.clip(model.logit(b), -30, 30))) - y[at]) / len(at)
            s = b @ v
            grads = [g.sum(keepdims=True), b.T @ g + 1e-4 * params[1], b.T @ (g[:, None] * s) - ((b * b).T @ g)[:, None] * v + 1e-4 * v]
            t += 1
            for p, q, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (q - m1)
                m2 += 0.001 * (q * q - m2)
                p -= 0.01 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    model.w0, model.w, model.v = float(params[0][0]), params[1], params[2]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, max_rows: int = 3000, max_bytes: int = 10_000_000, **options) -> QualityModel:
    """Learns from at most max_rows labelled rows, and max_bytes of text, of either class (lowest hash of the id) for which learn holds."""
    chosen = labelled_sample(docs, labels, "quality", learn, max_rows, max_bytes, ("n_chars",)).orderBy("doc_id", "text").select("text", F.col("n_chars").cast("long"), "y")
    # the texts are featurised as they come, a partition at a time
    return train(map(tuple, chosen.toLocalIterator()), **options)


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) for every row, with the columns of docs named in keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordBuckets(model.buckets)
        for pdf in batches:
            for lo in range(0, len(pdf), 128):
                part = pdf.iloc[lo : lo + 128]
                if model.w is None:
                    score = np.full(len(part), model.prior)
                else:
                    stats, x = np.empty((len(part), len(STATS))), model.empty(len(part))
                    for i, (t, n) in enumerate(zip(part["text"], part["n_chars"], strict=True)):
                        stats[i], x[i, : model.buckets] = featurise(t if isinstance(t, str) else "", n, cache)
                    model.fill(x, stats)
                    score = 1 / (1 + np.exp(-np.clip(model.logit(x), -30, 30)))
                yield part[[*out]].assign(score=np.asarray(score, dtype=np.float64))

    out = list(dict.fromkeys(["doc_id", *keep]))
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select(*(F.col(c).cast(kinds[c]).alias(c) for c in dict.fromkeys([*out, "text", "n_chars"])))
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in out) + ", score double")
