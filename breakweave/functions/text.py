"""Column functions on log text: normalisation, message shapes and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    # the end of a fold over nothing: an element of a transformed array would be copied whole, and ask all of body for its type, at every level and for every row
    return f"aggregate(array(), {value}, (acc0, x0) -> acc0, {name} -> {body})"


def _branches(pattern: str) -> bool:
    """Whether a pattern has alternatives outside all of its groups."""
    depth, listed, at = 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif listed:
            listed = c != "]"
        elif c == "[":
            listed = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
        at += 1
    return False


def matched(text: str, pattern: str, n: int, body: str) -> str:
    """body with m standing for the n groups of the pattern's first match in a line, from m[1] on, empty where a group took no part; null where it matches nowhere.

    One search gives all groups. They stand on lines of their own, since a line holds no line end.
    """
    first = re.match(r"(?:\(\?\w+\))?\^", pattern) and not _branches(pattern)
    whole = quoted(("" if first else r"^[\s\S]*?") + f"(?:{pattern})" + r"[\s\S]*")
    cut = "".join(f"\\n${i + 1}" for i in range(n))
    return let("found", f"regexp_replace({text}, {whole}, '{cut}')", f"if(startswith(found, '\\n'), {let('m', "split(found, '\\n', -1)", body)}, null)")


def strip_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def strip_ansi(text: Column) -> Column:
    """Removes CSI and OSC sequences, 7- and 8-bit; an OSC sequence ends on its own line."""
    return F.regexp_replace(text, "(?:\u001b\\[|\u009b)[0-?]*[ -/]*[@-~]|(?:\u001b\\]|\u009d)[^\u0007\u001b\u009c\n]*(?:\u0007|\u001b\\\\|\u009c)?|\u001b[@-Z\\\\^_]", "")


def drop_redraws(text: Column) -> Column:
    """Blanks lines that move the cursor up or down; they are redrawn later."""
    return F.regexp_replace(text, "(?m)^[^\n]*\u001b\\[[0-9;]*[ABEF][^\n]*$", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def once(text: Column, sep: str) -> Column:
    """A text that is one half twice, with sep between, becomes that half."""
    n = F.length(text)
    head = F.substring(text, F.lit(1), ((n - len(sep)) / 2).cast("int"))
    return F.when((n > len(sep)) & (n % 2 == len(sep) % 2) & (text == F.concat(head, F.lit(sep), head)), head).otherwise(text)


def collapse_repeats(message: Column) -> Column:
    """Runs of three or more equal lines become one line with (xN)."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def shown(acc: Column) -> Column:
        line, n = acc["last"], acc["n"]
        many = F.concat(line, F.lit(" (x"), n.cast("string"), F.lit(")"))
        return F.when(n == 0, acc["out"]).when((n >= 3) & (F.trim(line) != ""), F.array_append(acc["out"], many)).otherwise(F.concat(acc["out"], F.array_repeat(line, n)))

    def step(acc: Column, line: Column) -> Column:
        same = acc["last"].eqNullSafe(line)
        return F.when(same, F.struct(acc["out"].alias("out"), line.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(shown(acc).alias("out"), line.alias("last"), F.lit(1).alias("n")))

    collapsed = F.aggregate(F.split(message, "\n", -1), start, step, lambda acc: F.array_join(shown(acc), "\n"))
    return F.when(message.contains("\n"), collapsed).otherwise(message)


def collapsed(message: str) -> str:
    """As collapse_repeats, of SQL text. A run is the lines from one that differs from the line before it up to the next such line."""
    runs = "filter(sequence(0, size(m) - 1), i -> i = 0 or get(m, i) <> get(m, i - 1))"
    shown = "if(n >= 3 and trim(get(m, p)) <> '', array(concat(get(m, p), ' (x', n, ')')), array_repeat(get(m, p), n))"
    each = let("n", "coalesce(get(at, k + 1), size(m)) - p", shown)
    text = let("m", "split(t, '\\n', -1)", let("at", runs, f"array_join(flatten(transform(at, (p, k) -> {each})), '\\n')"))
    return let("t", message, f"if(contains(t, '\\n'), {text}, t)")


def skeleton(message: Column) -> Column:
    """A message's shape: quoted text, URLs, paths, ids and numbers become placeholders."""
    text = F.regexp_replace(F.substring(message, 1, 1000), r"\s+", " ")
    for pattern, to in (
        ("\"[^\"]{0,200}\"|'[^']{0,200}'|`[^`]{0,200}`", "<str>"), (r"[a-z]+://[^ ]+", "<url>"), (r"(?:[A-Za-z]:)?(?:\.{0,2}/)?[\w.@-]+(?:/[\w.@-]+)+", "<path>"),
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"\b0x[0-9a-fA-F]+\b", "<addr>"), (r"\b[0-9a-f]*[0-9][0-9a-f]{6,}[a-f][0-9a-f]*\b", "<hex>"), (r"\d+(?:\.\d+)?", "<num>"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.substring(F.trim(text), 1, 512)


def fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 24)


def content_score(shape: Column) -> Column:
    """How many different words a shape has besides its placeholders."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.regexp_replace(shape, "<[a-z]+>", " "), F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))))


NOISE_PATH = r"node_modules/|site-packages/|dist-packages/|^node:|^internal/|<frozen |/lib/python[0-9.]+/|/gems/|/rustc/|vendor/bundle/|/src/(?:runtime|testing|internal)/"


def is_noise_path(path: Column) -> Column:
    return F.coalesce(path.rlike(NOISE_PATH), F.lit(False))


def file_url_path(url: Column) -> Column:
    """The path of a file: URL; percent-encoding is decoded and a plus sign stays."""
    path = F.try_url_decode(F.replace(F.regexp_replace(url, r"^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(url.startswith("file://"), F.regexp_replace(path, r"^/([A-Za-z]:)", "$1")).otherwise(url)


def clip(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def relative_path(path: Column, cwd: Column) -> Column:
    inside = path.startswith(F.concat(cwd, F.lit("/"))) | path.startswith(F.concat(cwd, F.lit("\\")))
    return F.when(inside, F.substring(path, F.length(cwd) + 2, F.length(path))).otherwise(path)
