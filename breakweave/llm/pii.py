"""Personal data by boosted trees over candidate spans.

Base spans (e-mail, ip, card, phone) follow fixed formats and are always kept. Further generators with high recall propose
spans, which may overlap: local phone numbers, national ids, IBANs, dates, secrets, spelled-out e-mail addresses, MAC and IPv6
addresses. Gradient-boosted trees score them by format and context; a kind's threshold is the score below which
neighbours by score, in the calibration part of the training set, no longer have the asked precision; of overlapping accepted spans the likeliest stays, and none that overlaps a base span.

No labels of personal data come with the documents, so the trees learn from sentences drawn by rule: each format in contexts that tell,
and numbers and tokens of the same look in contexts that don't (order numbers, versions, checksums). The draw is seeded and of fixed size.

Null, empty or blank text: no spans. Repeated rows: equal spans. Ties between overlapping spans: the earlier, then the longer. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits: it would have started at the run's first one
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


_DIGITS = re.compile(r"[0-9]+")
REACH = 160


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, merged where they meet; every format but phone and spelled-out addresses lies within one."""
    out: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        lo, hi = max(0, m.start() - REACH), m.end() + REACH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base formats, each leftmost and non-overlapping in its kind; a match that fails its check is dropped, not retried."""
    out: list[tuple[int, int, str]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    near = zones(text)
    for m in (m for lo, hi in near for m in _IP.finditer(text, lo, hi)):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in (m for lo, hi in near for m in _CARD.finditer(text, lo, hi)):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2]), s[1]))


#: Generators of candidates: kind and pattern, each with a digit in it but for spelled_email. Every repetition is bounded, or (secret) tried at a token's start alone, so a text is scanned in linear time.
GENERATORS = (
    ("local_phone", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("date", re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}")),
    ("account", re.compile(r"(?<![0-9.+-])[0-9]{8,18}(?![0-9.])")),
    ("spelled_email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,40} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}")),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
)
KINDS = tuple(k for k, _ in GENERATORS)
UNBOUNDED = ("secret", "spelled_email")  # not held to the neighbourhood of a digit
#: Words before a span that tell of a kind.
TELLING = {
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell"), "national_id": ("ssn", "social", "national", "id", "tax"), "iban": ("iban", "bank", "account"),
    "date": ("born", "birth", "dob", "birthday"), "secret": ("token", "key", "secret", "password", "passwd", "api", "bearer", "auth"),
    "account": ("account", "acct", "customer", "passport", "licence", "license", "iban"), "spelled_email": ("mail", "contact", "write", "reach"), "mac": ("mac", "device", "ether"), "ipv6": ("ip", "host", "addr", "from"),
}
PLAIN = ("order", "invoice", "version", "build", "commit", "sha", "checksum", "page", "part", "isbn", "item", "released", "published", "updated", "hash", "ticket", "row", "serial", "at", "ratio")
_WORDS = re.compile(r"[a-z]+")
WIDTH = 32


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span."""
    span, before = text[start:end], text[max(0, start - WIDTH) : start].lower()
    after = text[end : end + WIDTH].lower()
    n = len(span)
    digits = [c for c in span if c in "0123456789"]
    counts = Counter(span)
    words = _WORDS.findall(before)[-4:]
    own = TELLING[kind]
    tells = [i for i, w in enumerate(reversed(words)) if w in own or any(len(t) > 3 and t in w for t in own)]
    plain = [i for i, w in enumerate(reversed(words)) if w in PLAIN]
    return [
        KINDS.index(kind), n, len(digits) / n, sum(c.isalpha() for c in span) / n, sum(c.isupper() for c in span) / n, sum(not c.isalnum() for c in span),
        -sum(v / n * np.log2(v / n) for v in counts.values()), float(luhn("".join(digits))) if digits else 0.0, float(kind == "iban" and mod97(span)),
        tells[0] if tells else 9, plain[0] if plain else 9, float(before[-2:].strip(" ") in ('"', "'", "=", ":")), float("=" in before[-4:]), float(":" in before[-3:]),
        float(bool(re.fullmatch(r"[0-9a-f]+", span))), float(any(w in own for w in _WORDS.findall(after)[:3])), len(set(span)) / n,
    ]


def mod97(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@dataclass
class Trees:
    """Boosted trees in flat arrays: feature, threshold and value of each node; the children of i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.base), int(np.log2(self.feature.shape[1] + 1)) - 1
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: float = 1.0) -> Trees:
    """Gradient boosting on the logistic loss, with second-order gains on quantile cuts."""
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    nodes = 2 ** (depth + 1) - 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    trees = Trees(np.zeros((n_trees, nodes), np.int64), np.full((n_trees, nodes), np.inf), np.zeros((n_trees, nodes)), base, {})
    f = np.full(len(y), base)
    for k in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h, at = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
        for node in range(2**depth - 1):
            here = np.flatnonzero(at == node)
            if not len(here):
                continue
            gs, hs = g[here].sum(), h[here].sum()
            best = (1e-6, 0, np.inf)
            for j, c in enumerate(cuts):
                slot = np.searchsorted(c, x[here, j], side="left")
                gl, hl = np.cumsum(np.bincount(slot, g[here], len(c) + 1))[:-1], np.cumsum(np.bincount(slot, h[here], len(c) + 1))[:-1]
                gain = gl**2 / (hl + least) + (gs - gl) ** 2 / (hs - hl + least) - gs**2 / (hs + least)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, c[gain.argmax()])
            trees.feature[k, node], trees.threshold[k, node] = best[1], best[2]
            at[here] = 2 * node + 1 + (x[here, best[1]] > best[2])
        for leaf in np.unique(at):
            mine = at == leaf
            trees.value[k, leaf] = -rate * g[mine].sum() / (h[mine].sum() + least)
        f += trees.value[k, at]
    return trees


def drawn_sentences(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of spans in sentences drawn by rule."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda k, of: "".join(r.choice(of) for _ in range(k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban(good: bool) -> str:
        while True:
            s = r.choice(("DE", "FR", "ES", "GB")) + digit(2) + digit(16)
            if mod97(s) == good:
                return s

    make = {
        "local_phone": lambda _: r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}")).format(digit(3), digit(3), digit(4)), "national_id": lambda _: f"{digit(3)}-{digit(2)}-{digit(4)}", "iban": iban,
        "date": lambda _: r.choice((f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1930, 2020)}", f"{r.randint(1930, 2020)}-{r.randint(10, 12)}-{r.randint(10, 28)}")),
        "secret": lambda good: some(40, hexes) if r.random() < 0.6 else some(r.randint(16, 64), mixed) + digit(1), "account": lambda _: digit(r.randint(8, 17)),
        "spelled_email": lambda _: f"{some(6, 'abcdefgh')} at {some(6, 'ijklmno')} dot {r.choice(('com', 'org', 'net'))}", "mac": lambda _: ":".join(some(2, hexes) for _ in range(6)), "ipv6": lambda _: ":".join(some(4, hexes) for _ in range(8)),
    }
    filler = [some(r.randint(2, 9), "aeinorstlhd") for _ in range(400)]
    out = []
    for i in range(n):
        kind, good = KINDS[i % len(KINDS)], r.random() < 0.5
        span = make[kind](good)
        words = [r.choice(filler) for _ in range(r.randint(2, 8))]
        # contexts mislead at times: one in six of either label has none that tells, one in twelve plain spans has one that does
        u = r.random()
        cue = r.choice(filler) if u < 1 / 6 else r.choice(TELLING[kind]) if good or u > 11 / 12 else r.choice(PLAIN) if u < 2 / 3 else r.choice(filler)
        sep = r.choice((" ", ": ", " = ", ' = "', " is "))
        text = " ".join(words) + " " + cue + sep
        start = len(text)
        text += span + ('"' if sep.endswith('"') else "") + " " + " ".join(r.choice(filler) for _ in range(4))
        out.append((text, kind, start, start + len(span), int(good)))
    return out


@lru_cache(maxsize=2)
def fit_pii(n: int = 9000, seed: int = 3, precision: float = 0.6, near: int = 40) -> Trees:
    """Trees from n drawn sentences, a third of which calibrate the thresholds."""
    rows = drawn_sentences(n, seed)
    x, y = np.array([features(t, a, b, k) for t, k, a, b, _ in rows], dtype=float), np.array([r[4] for r in rows], dtype=float)
    held = np.arange(len(rows)) // len(KINDS) % 3 == 0
    trees = boost(x[~held], y[~held])
    p = trees.score(x)
    for k, kind in enumerate(KINDS):
        mine = held & (x[:, 0] == k)
        order = np.argsort(-p[mine])
        share = np.convolve(y[mine][order], np.ones(near) / near, "valid")
        low = np.append(np.flatnonzero(share < precision), len(share))[0]
        trees.thresholds[kind] = float(p[mine][order][low + near // 2 - 1]) if low else 1.1
    return trees


class Taken:
    """Disjoint intervals in order, to which one is added only where it is free; a search each."""

    def __init__(self, spans: list[tuple[int, int, str]] = ()):
        self.start: list[int] = []
        self.end: list[int] = []
        for a, b, _ in sorted(spans):
            if self.end and a < self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.end, a)
        return i == len(self.start) or self.start[i] >= b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.end, a)
        self.start.insert(i, a)
        self.end.insert(i, b)


def added_spans(text: str, base: list[tuple[int, int, str]], trees: Trees) -> list[tuple[int, int, str]]:
    """Accepted candidates, none overlapping another or a base span."""
    near = zones(text)
    found = [(m.start(), m.end(), kind) for kind, pattern in GENERATORS if kind not in UNBOUNDED for lo, hi in near for m in pattern.finditer(text, lo, hi)]
    for kind, pattern in GENERATORS:
        if kind == "secret" and near or kind == "spelled_email" and any(d in text for d in (" dot ", "dot)", "dot]")):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if not found:
        return []
    taken = Taken(base)
    free = [s for s in sorted(found) if taken.free(s[0], s[1])]
    if not free:
        return []
    p = trees.score(np.array([features(text, *s) for s in free], dtype=float))
    out = []
    for j in sorted(range(len(free)), key=lambda j: (-p[j], free[j][0], -free[j][1])):
        a, b, kind = free[j]
        if p[j] >= trees.thresholds[kind] and taken.free(a, b):
            taken.add(a, b)
            out.append(free[j])
    return out


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans, base_sha256, spans) of every row; spans are kind:start:end by start, base kinds first."""
    trees = trees or fit_pii()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = {k: i for i, k in enumerate((*BASE_KINDS, *KINDS))}
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                added = added_spans(text, base, trees)
                kinds = Counter(s[2] for s in base)
                every = sorted(base + added, key=lambda s: (s[0], rank[s[2]], s[1]))
                rows.append((*(kinds[k] for k in BASE_KINDS), len(added), len(every), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together by the first one's kind."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
