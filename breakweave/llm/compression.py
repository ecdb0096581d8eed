"""Quality rules by compression: texts that zstandard shortens too well repeat themselves, texts that it hardly shortens hold no prose.

A document is judged whole and in fixed chunks of its UTF-8 bytes (a rest of under half a chunk joins the chunk before). BANDS gives the smallest and largest share
(compressed by raw bytes) that a text of so many bytes may have: short texts compress less, so their band lies higher and is wider. A document is rejected as a
whole outside its band, or if more than BAD_SHARE of its chunk bytes lie in chunks outside the band of a chunk's size. The base rules come first: fewer than 50 words, or more
than half of the words in three-word windows that the text repeats. All figures are of one document, so one pass over the texts gives them and nothing is shuffled.

Null text: no words, nothing else, rejected by the base rules; its shares are null, like those of an empty text. Long texts: compressed as a stream, chunk by chunk. Repeated
rows, rows without an id: each has its own, equal figures. Ties: a share equal to a limit is within the band. Empty table: no rows. Further columns are ignored.
Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import texts

LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.25
MIN_WORDS, MOST_REPEATED = 50, 50
#: From so many bytes on: the smallest and largest share that remains. Prose of any alphabet lies well within, encoded bytes and repeated lines outside.
BANDS = ((0, 0.50, 1.60), (128, 0.42, 1.00), (256, 0.34, 0.88), (512, 0.28, 0.82), (1024, 0.24, 0.77), (2048, 0.21, 0.74), (4096, 0.19, 0.72), (16384, 0.17, 0.70), (65536, 0.15, 0.69), (1 << 20, 0.12, 0.68))
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANK = b" \t\n\v\f\r"
SCHEMA = (
    "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, lowest_chunk double, highest_chunk double, bad_chunk_share double"
)


def within(size: int, share: float, bands: tuple = BANDS) -> bool:
    """Whether a text of size bytes may have the share."""
    _, low, high = bands[bisect_right(bands, size, key=lambda b: b[0]) - 1]
    return low <= share <= high


def pieces(size: int, chunk: int) -> list[tuple[int, int]]:
    """The chunks of a text of size bytes."""
    n = max(1, size // chunk + (size % chunk * 2 >= chunk))
    return [(i * chunk, size if i == n - 1 else (i + 1) * chunk) for i in range(n)]


def whole_size(raw: bytes, tool: zstandard.ZstdCompressor) -> int:
    """Compressed bytes of a text; long ones pass as a stream."""
    if len(raw) <= 1 << 20:
        return len(tool.compress(raw))
    stream = tool.compressobj()
    return sum(len(stream.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(stream.flush())


def shares(raw: bytes, tool: zstandard.ZstdCompressor, chunk: int = CHUNK, bands: tuple = BANDS) -> tuple[float, float, float, float]:
    """A text's share, its chunks' smallest and largest, and the part of its bytes in chunks outside their band."""
    parts = pieces(len(raw), chunk)
    ratio = whole_size(raw, tool) / len(raw)
    each = [ratio] if len(parts) == 1 else [len(tool.compress(raw[a:b])) / (b - a) for a, b in parts]
    bad = sum(b - a for (a, b), share in zip(parts, each) if not within(b - a, share, bands))
    return ratio, min(each), max(each), bad / len(raw)


def repeated_words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words, their code points, symbols, and words in three-word windows that occur twice or more in it."""
    raw, starts, ends, first = W.tokenise(parts)
    n = np.diff(first)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    at = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    letters = at(((raw & 0xC0) != 0x80) & ~W.SPACE[raw])
    symbols = at(SYMBOLS[raw])
    doc = np.repeat(np.arange(len(parts)), n)
    covered = np.zeros(len(doc), dtype=bool)
    if len(doc) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        runs = W.windows(W.hashes(raw, starts, ends), 3)[inside]
        by = np.lexsort((runs, doc[inside]))
        d, h = doc[inside][by], runs[by]
        same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        again = np.zeros(len(by), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        found = inside[by[again]]
        for k in range(3):
            covered[found + k] = True
    return n, letters, symbols, np.bincount(doc[covered], minlength=len(parts))


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK, bad_share: float = BAD_SHARE, bands: tuple = BANDS) -> DataFrame:
    """SCHEMA for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdCompressor(level=level, write_content_size=False)
        for pdf in batches:
            for at, parts in W.chunks(pdf["text"].tolist()):
                n, letters, symbols, repeats = repeated_words(parts)
                failed = (n < MIN_WORDS) | (100 * repeats > MOST_REPEATED * n)
                figures = [shares(raw, tool, chunk, bands) if raw else (None, None, None, None) for raw in parts]
                kept = [not bad and within(len(raw), f[0], bands) and f[3] <= bad_share for raw, f, bad in zip(parts, figures, failed)]
                columns = zip(*figures)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[at : at + len(parts)].array, "n_words": n, "word_chars": letters, "n_symbols": symbols, "n_dup_lines": [repeated_lines(raw) for raw in parts], "n_repeat_words": repeats,
                    "base_failed": failed, "kept": kept, **{c: pd.array(list(v), dtype="Float64") for c, v in zip(("ratio", "lowest_chunk", "highest_chunk", "bad_chunk_share"), columns)},
                })

    # ids pass as text: pandas would round large ones beside nulls
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, as they are; rows that share an id are kept if one of them is, rows without an id are judged alike by text."""
    kept = judge(docs, **options).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]), "left_semi")
