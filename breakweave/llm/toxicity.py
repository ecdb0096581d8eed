"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on whole toxic rows and one on whole ordinary rows. A dictionary has a shared part, which zstd's
trainer draws from the windows of ordinary rows, and an own part, which it draws from those stretches of its class's rows whose k-mers the
other class's rows hold significantly less often. Windows of ordinary rows that still come out shorter with the toxic dictionary are trained
into the shared part of both. Every window of a text is compressed with both dictionaries; a window that comes out shorter with the toxic one
speaks for toxicity. Thresholds on the bytes saved are calibrated by a logistic curve over a document's largest savings, on labelled rows
that the dictionaries at hand have not seen (cross-fitted), both classes weighing alike.

Null, empty or blank text: no windows, so the score of a document without any saving. Repeated ids and
texts: each row gets its own (equal) score. No labelled row of one class: the score is the share of
class 1 among the labelled rows, 0 without any.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, texts

KMER, BITS = 6, 22


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    window: int
    min_match: int
    strong: int
    weights: np.ndarray
    prior: float

    def compressors(self):
        import zstandard as z

        out = []
        for content in (self.toxic, self.ordinary):
            p = z.ZstdCompressionParameters.from_level(
                12, source_size=self.window, dict_size=len(content), min_match=self.min_match, strategy=z.STRATEGY_GREEDY, search_log=6,
                target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            out.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p))
        return out


def window_pattern(size: int) -> re.Pattern:
    """Windows of whole words up to size bytes, with the space before them; longer words are cut."""
    return re.compile(rb"(?s)(?:\s.{1,%d}|.{%d})(?=\s|$)|.{1,%d}" % (size, size, size))


def saved(tools, windows: list[bytes], most: int = 50_000) -> np.ndarray:
    """Bytes by which each window comes out shorter with the toxic dictionary."""
    out = np.zeros(len(windows), np.int32)
    for tool, sign in zip(tools, (-1, 1), strict=True):
        for lo in range(0, len(windows), most):
            buf = tool.multi_compress_to_buffer(windows[lo : lo + most], threads=1)
            out[lo : lo + most] += sign * np.fromiter((len(buf[i]) for i in range(len(buf))), dtype=np.int32, count=len(buf))
    return out


def savings(model: ToxicityModel, rows: list[str], tools, pattern: re.Pattern, most: int = 200_000) -> np.ndarray:
    """For each text: largest saving, sum of the three largest, count of strong ones (log), count of windows (log).

    Windows are compressed some most at a time, so memory doesn't grow with a text's length.
    """
    out = np.zeros((len(rows), 4))
    windows: list[bytes] = []
    owner: list[tuple[int, int]] = []
    kept: dict[int, list] = {}

    def flush():
        if not windows:
            return
        gain = saved(tools, windows)
        at = 0
        for row, n in owner:
            g = gain[at : at + n]
            at += n
            top, strong, total = kept.get(row, ([], 0, 0))
            best = np.sort(np.concatenate([np.asarray(top, dtype=np.int32), g]))[::-1][:3]
            kept[row] = (best.tolist(), strong + int((g >= model.strong).sum()), total + n)
        windows.clear()
        owner.clear()

    for i, text in enumerate(rows):
        ws = pattern.findall(b" " + text.lower().encode("utf-8", "replace")) if text else []
        for lo in range(0, len(ws), most):
            part = ws[lo : lo + most]
            windows.extend(part)
            owner.append((i, len(part)))
            if len(windows) >= most:
                flush()
    flush()
    for row, (best, strong, total) in kept.items():
        out[row] = best[0], sum(max(0, b) for b in best), math.log1p(strong), math.log1p(total)
    return out


def trained(samples: list[bytes], size: int, segment: int = 32) -> bytes:
    """What zstd's trainer draws from the distinct samples, at most size bytes; all of them where they are no more."""
    import zstandard as z

    samples = list(dict.fromkeys(samples))
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return z.train_dictionary(size, samples, k=segment, d=KMER, f=18, split_point=1.0, accel=1, steps=1).as_bytes()
    except z.ZstdError:  # too few samples for the trainer
        return b"".join(samples)[-size:]


def kmers(raw: bytes) -> np.ndarray:
    """Hashes of BITS bits of all runs of KMER bytes."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(a) - KMER + 1)
    h = np.zeros(n, np.uint64)
    for i in range(KMER):
        h = h * np.uint64(0x100000001B3) + a[i : i + n] + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def own_kmers(mine: np.ndarray, other: np.ndarray, n_mine: int, n_other: int, ratio: float, evidence: float) -> np.ndarray:
    """Whether a k-mer is in a larger share of my rows, by the ratio at least and with that likelihood-ratio statistic."""
    own = np.zeros(len(mine), bool)
    at = np.flatnonzero(mine >= 4)
    a, b = mine[at].astype(float), other[at].astype(float)
    e = (a + b) * n_mine / (n_mine + n_other)
    g2 = 2 * (a * np.log(a / e) + np.where(b > 0, b * np.log(np.maximum(b, 1) / np.maximum(a + b - e, 1e-9)), 0))
    own[at] = (a / n_mine >= ratio * b / n_other) & (g2 >= evidence)
    return own


def stretches(rows: list[bytes], own: np.ndarray) -> list[bytes]:
    """The runs of the rows that own k-mers cover."""
    out = []
    for raw in rows:
        mark = own[kmers(raw)].astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark, [0]])))
        out += [raw[a : b + KMER - 1] for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def dictionaries(rows: list[tuple[str, int]], model: ToxicityModel, shared_bytes: int, own_bytes: int, ratio: float, evidence: float) -> None:
    """Trains the model's two dictionaries on whole rows of both classes."""
    pattern = window_pattern(model.window)
    byclass = [list(dict.fromkeys(b" " + t.lower().encode("utf-8", "replace") for t, k in rows if k == y)) for y in (0, 1)]
    counts = [np.zeros(1 << BITS, np.int32) for _ in byclass]
    for count, mine in zip(counts, byclass, strict=True):
        for raw in mine:
            count[np.unique(kmers(raw))] += 1
    own = [trained(stretches(byclass[y], own_kmers(counts[y], counts[1 - y], len(byclass[y]), len(byclass[1 - y]), ratio, evidence)), own_bytes, 16) for y in (0, 1)]
    del counts
    windows = list(dict.fromkeys(w for raw in byclass[0] for w in pattern.findall(raw)))
    shared = trained(windows, shared_bytes)
    own[0] = own[0][: len(own[1])].rjust(len(own[1]))
    for last in (False, True):
        model.toxic, model.ordinary = own[1] + shared, own[0] + shared
        if not last:
            wrong = [w for w, g in zip(windows, saved(model.compressors(), windows), strict=True) if g >= 2]
            shared = trained(wrong, shared_bytes // 16) + shared


def train(rows: list[tuple[str, int]], window: int = 64, min_match: int = 5, strong: int = 3, shared_bytes: int = 131072, own_bytes: int = 8192, ratio: float = 8.0, evidence: float = 25.0, folds: int = 3) -> ToxicityModel:
    """Trains dictionaries on the (text, label) rows; shared_bytes and own_bytes bound them. The calibration sees every fold of the rows, by a hash of the text, through dictionaries trained on the others."""
    rows = [(t or "", int(y)) for t, y in rows]
    y = np.array([r[1] for r in rows], dtype=float)
    model = ToxicityModel(b"", b"", window, min_match, strong, np.zeros(5), float(y.mean()) if len(y) else 0.0)
    if model.prior in (0.0, 1.0):
        return model
    x, known = np.zeros((len(rows), 4)), np.zeros(len(rows), bool)
    fold = np.array([crc32(t.encode("utf-8", "replace")) % folds for t, _ in rows])
    for k in range(folds):
        mine = np.flatnonzero(fold == k)
        if len(set(y[fold != k])) == 2 and len(mine):
            dictionaries([rows[i] for i in np.flatnonzero(fold != k)], model, shared_bytes, own_bytes, ratio, evidence)
            x[mine], known[mine] = savings(model, [rows[i][0] for i in mine], model.compressors(), window_pattern(window)), True
    dictionaries(rows, model, shared_bytes, own_bytes, ratio, evidence)
    if len(set(y[known])) == 2:
        model.weights = logistic(x[known], y[known])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing alike; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p))[:, None]) + pen, x.T @ (each * (y - p)) - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: F.Column, max_rows: int = 3000, max_bytes: int = 10_000_000, **options) -> ToxicityModel:
    """Learns from at most max_rows labelled rows, and max_bytes of text, of either class (those with the lowest hash of their id) for which learn holds."""
    rows = labelled_sample(docs, labels, "toxic", learn, max_rows, max_bytes).orderBy("doc_id", "text").select("text", "y").collect()
    return train([(r.text, r.y) for r in rows], **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, saving, n_windows) for every row; other columns of docs are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools, pattern = (model.compressors(), window_pattern(model.window)) if model.weights.any() else (None, None)
        for pdf in batches:
            n = len(pdf)
            if tools is None:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.full(n, model.prior), "saving": np.zeros(n), "n_windows": np.zeros(n, dtype=np.int64)})
                continue
            for lo in range(0, n, 512):
                part = pdf.iloc[lo : lo + 512]
                x = savings(model, part["text"].tolist(), tools, pattern)
                z = model.weights[0] + x @ model.weights[1:]
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "saving": x[:, 0], "n_windows": np.rint(np.expm1(x[:, 3])).astype(np.int64)})

    return texts(docs).mapInPandas(run, "doc_id long, score double, saving double, n_windows long")
