"""Words of whole texts as arrays: byte positions and 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_STEP)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_STEP)
    return h ^ (h >> np.uint64(32))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts; the order matters."""
    return mix(a * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019) ^ mix(b))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def chunks(rows: list, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 texts some most bytes at a time, with the index of the first; a longer text is alone."""
    part: list[bytes] = []
    at = held = 0
    for i, text in enumerate(rows):
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        if part and held + len(raw) > most:
            yield at, part
            part, held, at = [], 0, i
        part.append(raw)
        held += len(raw)
    if part:
        yield at, part


def tokenise(parts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, each word's start and end in them, and for each text the index of its first word (and the number of all)."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    space = SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    return raw, starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, from one running sum over all bytes."""
    power, inverse = _power(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling; the last n - 1 positions have none."""
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else join(out[: len(power) - have] if len(power) >= have else out[:0], power[have:])
            have += size
        if have == n:
            return out[: max(0, len(h) - n + 1)]
        power = join(power[: max(0, len(power) - size)], power[size:])
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each position the index of the first smallest of the width values from it on."""
    at, value, size = np.arange(len(h)), h, 1

    def joined(step: int) -> None:
        nonlocal at, value
        later = value[step:] < value[: len(value) - step]
        value = np.where(later, value[step:], value[: len(value) - step])
        at = np.where(later, at[step:], at[: len(at) - step])

    while 2 * size <= width:
        joined(size)
        size *= 2
    if size < width:
        joined(width - size)
    return at
