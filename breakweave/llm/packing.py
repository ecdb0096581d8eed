"""Token ids, packed by best-fit decreasing and written as binary rows.

Each text is turned into the ids of a public byte-level BPE vocabulary, with one end id after it. Documents longer than
a row are cut into pieces of a row's length, losslessly; the pieces of a buffer (a bounded number of tokens of one input
partition) are packed by best fit, longest first: a segment tree over the remaining capacities 0..length finds the fullest
row that still takes a piece. Nothing is shuffled.

Output, one row for each packed row: its ids as little-endian unsigned integers, padded to the row length, the cumulative
segment lengths, where positions start again from 0, and which document, and which part of it, each segment is.

Null or empty text: the end id alone. Repeated rows: packed each. Ties of length or capacity: the earlier piece, the latest opened row. An empty table: no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
BUFFER = 2_000_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, with the end id."""

    def __init__(self, path: str):
        self.encoding = encoder(path)
        self.end = len(self.encoding.token_byte_values())
        self.kind = np.dtype(np.uint16) if self.end < 65536 else np.dtype(np.uint32)

    def of(self, text: str) -> np.ndarray:
        ids = self.encoding.encode_ordinary(text)
        ids.append(self.end)
        return np.array(ids, dtype=self.kind)


class Capacities:
    """A segment tree that counts rows by remaining capacity and finds the smallest one at least as large as asked."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the capacity and row of the best fit."""
        i = need + self.size
        if not self.count[i]:
            # up to the first right sibling that has rows, then down to its smallest
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """The pieces of each row, as indexes, in the order in which they were put there."""
    tree, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            got = (length, len(rows))
            rows.append([])
        rows[got[1]].append(i)
        tree.add(got[0] - lengths[i], got[1])
    return rows


SCHEMA = "pack long, row int, n_tokens int, ids binary, id_bytes int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of all documents; see the module. pack numbers the buffers, row the rows in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of = Encoder(vocabulary)
        number = TaskContext.get().partitionId() << 32
        pieces: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> pd.DataFrame:
            out = []
            for r, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
                ids = np.concatenate([pieces[i][2] for i in members])
                cu = np.concatenate([[0], np.cumsum([len(pieces[i][2]) for i in members])]).tolist()
                full = np.full(length, ids_of.end, dtype=ids_of.kind)
                full[: len(ids)] = ids
                out.append((number, r, len(ids), full.astype(full.dtype.newbyteorder("<")).tobytes(), ids_of.kind.itemsize, cu, cu[:-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
            return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = ids_of.of(text)
                doc = None if doc is None or doc != doc else int(doc)
                for k, lo in enumerate(range(0, len(ids), length)):
                    pieces.append((doc, k, ids[lo : lo + length]))
                held += len(ids)
                if held >= buffer:
                    yield flush()
                    pieces, held = [], 0
                    number += 1
        if pieces:
            yield flush()

    return texts(docs).mapInPandas(run, SCHEMA)


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, text) of every segment, decoded as bytes shown in Latin-1; the inverse of pack, for tests and inspection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        end = len(enc.token_byte_values())
        for pdf in batches:
            out = []
            for raw, width, cu, doc_ids, parts in zip(pdf["ids"], pdf["id_bytes"], pdf["cu_seqlens"], pdf["doc_ids"], pdf["parts"], strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                for a, b, doc, part in zip(cu[:-1], cu[1:], doc_ids, parts, strict=True):
                    out.append((doc, part, enc.decode_bytes([i for i in ids[a:b].tolist() if i != end]).decode("latin-1")))
            yield pd.DataFrame(out, columns=["doc_id", "part", "text"])

    return packed.mapInPandas(run, "doc_id long, part int, text string")
