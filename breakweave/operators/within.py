"""Failures of a log found within its row: what parsing.located, blocks, hunks and parsing.deduplicated find in shuffled hits, for logs that are one row each.

A log's lines are in order in its row, so nothing is shuffled or sorted over many logs, and a task holds one log at a time, however many it is dealt. What a line is told by the lines
before it (the heading above, the block that it belongs to) comes from runs: positions at which something begins, repeated up to the next one. Every step takes time in proportion to a log's
lines, or to its failures times their logarithm. Expressions are SQL text, the parameter of a fold's last step standing for a value that is used several times (see let).
"""

from __future__ import annotations

import re

from ..functions import text as T
from ..functions.text import let
from . import blocks, hunks
from .readers import FIELDS, Block, Reader

#: What a reader says of one failure before it is made whole.
SAID = ("file", "line", "col", "code", "subject", "label", "severity", "message")
_SPANS = "array<struct<start:int,end:int>>"
#: Rows of a running maximum that are appended one by one; longer runs are chunks of so many.
CHUNK = 256


def kept(array: str) -> str:
    return f"filter({array}, x -> x is not null)"


def _struct(known: dict[str, str], fields=SAID) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {known.get(f, 'cast(null as string)')}" for f in fields) + "".join(f", '{k}', {v}" for k, v in known.items() if k not in fields) + ")"


def _when(pattern: str, groups: tuple[str, ...], fields, more: dict[str, str] = {}) -> str:
    """What the line text says, and more, where the pattern finds it, else null."""
    return T.matched("text", pattern, len(groups), _struct(blocks.groups_of(groups) | {"line_no": "line_no"} | more, fields))


def last_of(size: str, values: str, name: str) -> str:
    """The values of an array of that size, each null replaced by the last value before it."""
    at = f"filter(sequence(0, {size} - 1), i -> get({name}, i) is not null)"
    runs = f"transform(at, (p, k) -> array_repeat(get({name}, p), coalesce(get(at, k + 1), {size}) - p))"
    return let(name, values, let("at", at, f"flatten(concat(array(array_repeat(cast(null as string), coalesce(get(at, 0), {size}))), {runs}))"))


def _single(r: Reader) -> str:
    """The failures of a reader of single lines, with the heading above and the place near them."""
    tries = [(r.pattern, r.groups), *((p, tuple(g.split())) for p, g in r.alts)]
    alone = not (r.heading or r.reach)
    whens = [_when(p, g, SAID, {"n": "0", "start": "line_no", "end": "line_no"} if alone else {}) for p, g in tries]
    if len(whens) == 1:
        found = kept(f"transform(ls, (text, line_no) -> {whens[0]})")
    else:
        found = kept(f"flatten(transform(ls, (text, line_no) -> array({', '.join(whens)})))")
    if alone:
        return found
    cell = {f: f"d.{f}" for f in SAID}
    file = ["d.file"]
    if r.reach:
        near = ", ".join(f"get(ps, d.line_no {'+' if r.reach > 0 else '-'} {k})" for k in range(1, abs(r.reach) + 1))
        near = near if abs(r.reach) == 1 else f"coalesce({near})"
        file.append("p.file")
    if r.heading:
        file.append("get(hs, d.line_no - 1)")
    cell["file"] = f"coalesce({', '.join(file)})" if len(file) > 1 else file[0]
    if r.reach:
        cell |= {"line": "coalesce(d.line, p.line)", "col": "coalesce(d.col, p.col)"}
        body = _struct(cell | {"line_no": "d.line_no", "n": "0", "start": "least(d.line_no, coalesce(p.line_no, d.line_no))", "end": "greatest(d.line_no, coalesce(p.line_no, d.line_no))"})
        out = f"transform(ds, d -> {let('p', near, body)})"
        out = let("ps", f"transform(ls, (text, line_no) -> {_when(r.at, r.at_groups, ('file', 'line', 'col'))})", out)
    else:
        out = f"transform(ds, d -> {_struct(cell | {'line_no': 'd.line_no', 'n': '0', 'start': 'd.line_no', 'end': 'd.line_no'})})"
    if r.heading:
        heads = f"transform(ls, text -> nullif(regexp_extract(text, {T.quoted(r.heading)}, 1), ''))"
        out = let("hs", last_of("size(ls)", heads, "hv"), out)
    return let("ds", found, f"if(size(ds) = 0, cast(array() as {CANDIDATES}), {out})")


CANDIDATES = "array<struct<" + ",".join(f"{f}:string" for f in SAID) + ",line_no:int,n:int,start:int,end:int>>"


def _lines(role: str) -> str:
    """(line_no, h) of the lines that have the role."""
    return f"filter(transform(ls, (text, line_no) -> named_struct('line_no', line_no, 'h', {role})), x -> x.h is not null)"


def _kind(x: str, *kinds: str) -> str:
    return f"{x}.h.kind in ({', '.join(T.quoted(k) for k in kinds)})"


def _said(b: Block) -> str:
    """What a block says: e, its lines in order, and o, the line that opens it, above which the file a stands."""
    within = bool(b.keys or b.events)
    place = f"get(cs, {'size(cs) - 1' if b.last else '0'})"
    said = "filter(e, x -> x.h.kind in ('say', 'place') and x.h.message is not null and coalesce(x.line_no < st, true))"
    names = "transform(filter(filter(e, x -> x.h.kind = 'name'), (x, i) -> x.line_no = o.line_no + i + 1), x -> x.h.subject)"
    message = f"coalesce(nullif(array_join(slice(transform({said}, x -> x.h.message), 1, {b.most}), '\\n'), ''), get(reverse(filter(e, x -> x.h.kind = 'spare')), 0).h.message, o.h.message)"
    known = {
        "file": "coalesce(p.h.file, o.h.file, a)", "line": "coalesce(p.h.line, o.h.line)", "col": "coalesce(p.h.col, o.h.col)", "code": "o.h.code",
        "subject": f"if(o.h.subject is null, null, regexp_replace(array_join(concat(array(o.h.subject), {names}), ' '), ':$', ''))", "severity": "o.h.severity", "message": message,
        "line_no": "o.line_no", "n": "0",
        "start": "least(o.line_no, coalesce(p.line_no, o.line_no))" if within else "o.line_no",
        "end": "greatest(o.line_no, coalesce(p.line_no, o.line_no))" if within else f"array_max(transform(filter(e, x -> {_kind('x', 'open', 'say', 'place', 'spare', 'name')}), x -> x.line_no))",
    }
    body = _struct(known)
    if b.needs:
        body = let("v", body, "if(v.message is not null or p is not null, v, null)")
    clean = f"filter(e, x -> x.h.kind = 'place' and not coalesce(x.h.file rlike {T.quoted(T.NOISE_PATH)}, false))"
    return let("cs", clean, let("p", place, let("st", "get(filter(e, x -> x.h.kind = 'stop'), 0).line_no", body)))


def _sessions(r: Reader) -> str:
    """The blocks of a log, from rs, its lines with a role for the reader."""
    b = r.block
    none = f"cast(array() as {CANDIDATES})"
    if b.keys or b.events:
        return f"if(not exists(rs, x -> x.h.kind = 'open'), {none}, {_keyed(b)})"
    cuts = f"filter(sequence(0, size(rs) - 1), i -> {_kind('get(rs, i)', 'open', 'close', 'region')})"
    spans = "filter(transform(ks, (p, k) -> named_struct('p', p, 'e', coalesce(get(ks, k + 1), size(rs)))), s -> get(rs, s.p).h.kind = 'open')"
    if b.region:
        spans = f"filter({spans}, s -> coalesce(get(rs, s.p).line_no > get(filter(rs, x -> x.h.kind = 'region'), 0).line_no, false))"
        spans = let("rg", "get(filter(rs, x -> x.h.kind = 'region'), 0).line_no", spans.replace("get(filter(rs, x -> x.h.kind = 'region'), 0).line_no", "rg"))
    above = "get(hs, s.p)" if r.heading else "cast(null as string)"
    each = let("e", "slice(rs, s.p + 1, s.e - s.p)", let("o", "get(e, 0)", let("a", above, _said(b))))
    out = let("ks", cuts, f"transform({spans}, s -> {each})")
    if r.heading:
        out = let("hs", last_of("size(rs)", "transform(rs, x -> if(x.h.kind = 'head', x.h.file, null))", "hv"), out)
    return f"if(not exists(rs, x -> x.h.kind = 'open'), {none}, {kept(out)})"


def _keyed(b: Block) -> str:
    """Blocks of interleaved tests: lines by segment and test, then by the failures of the test."""
    none = "cast(null as string)"
    own = "if(x.h.kind = 'open', coalesce(x.h.label, x.h.subject), coalesce(x.h.label, get(ns, i)))"
    named = last_of("size(rs)", f"transform(rs, x -> case when x.h.kind = 'close' then '' when x.h.kind in ('key', 'open') then coalesce(x.h.label, x.h.subject) end)", "nv")
    # how many closing lines came so far: runs between them, numbered
    ends = "filter(sequence(0, size(rs) - 1), i -> get(rs, i).h.kind in ('close', 'region'))"
    block = let("ks", ends, "flatten(concat(array(array_repeat(0, coalesce(get(ks, 0), size(rs)))), transform(ks, (p, k) -> array_repeat(k + 1, coalesce(get(ks, k + 1), size(rs)) - p))))")
    rows = let("ns", named, let("bs", block, f"sort_array(transform(rs, (x, i) -> named_struct('block', get(bs, i), 'key', {own}, 'line_no', x.line_no, 'x', x)))"))
    begins = "filter(sequence(0, size(gs) - 1), i -> i = 0 or get(gs, i).block <> get(gs, i - 1).block or not (get(gs, i).key <=> get(gs, i - 1).key))"
    # one test's lines of a segment: each failure has those after it, or up to it where the output names tests as they run
    opens = "filter(sequence(0, size(g) - 1), i -> get(g, i).h.kind = 'open')"
    upto = "coalesce(get(os, j + 1), size(g))"
    after = f"named_struct('p', p, 'b', if(j = 0, 0, p), 'e', {upto})"
    before = "named_struct('p', p, 'b', if(j = 0, 0, get(os, j - 1) + 1), 'e', if(j = size(os) - 1, size(g), p + 1))"
    span = before if b.events else f"if(rn, {before}, {after})"
    each = let("e", "slice(g, s.b + 1, s.e - s.b)", let("o", "get(g, s.p)", let("a", none, _said(b))))
    group = let("g", "transform(slice(gs, q + 1, coalesce(get(qs, k + 1), size(gs)) - q), y -> y.x)", let("os", opens, f"transform(transform(os, (p, j) -> {span}), s -> {each})"))
    out = let("gs", rows, let("qs", begins, f"flatten(transform(qs, (q, k) -> {group}))"))
    return kept(out if b.events else let("rn", "exists(rs, x -> x.h.kind = 'key')", out))


def _paired(r: Reader) -> str:
    """Blocks bl and summary lines ss of one log, the n-th of a name with the n-th; lines alone where no block opens."""
    rest = (*SAID, "line_no", "n", "start", "end")
    line = _struct({f: f"x.h.{f}" for f in SAID} | {"line_no": "x.line_no", "n": "0", "start": "x.line_no", "end": "x.line_no"})
    alone = _struct({f: f"x.{f}" for f in SAID} | {"subject": "coalesce(x.subject, x.file)"} | {f: f"x.{f}" for f in ("line_no", "n", "start", "end")})
    name = "regexp_replace(regexp_replace(coalesce(x.subject, x.file), '^ERROR (?:collecting|at (?:setup|teardown) of) ', ''), '::', '.')"
    named = lambda a, side: f"transform({a}, x -> named_struct('name', {name}, 'side', {side}, 'line_no', x.line_no, 'x', x))"
    begins = "filter(sequence(0, size(gs) - 1), i -> i = 0 or not (get(gs, i).name <=> get(gs, i - 1).name))"
    first = {"severity", "label"}
    pick = lambda c: f"coalesce(s.{c}, b.{c})" if c in first else f"coalesce(b.{c}, s.{c})"
    met = _struct({c: f"coalesce(s.subject, get(g, 0).name)" if c == "subject" else pick(c) for c in rest})
    sides = lambda n: f"transform(filter(g, y -> y.side = {n}), y -> y.x)"
    pairs = let("b0", sides(0), let("s0", sides(1), f"transform(sequence(0, greatest(size(b0), size(s0)) - 1), j -> {let('b', 'get(b0, j)', let('s', 'get(s0, j)', met))})"))
    group = let("g", "slice(gs, q + 1, coalesce(get(qs, k + 1), size(gs)) - q)", pairs)
    both = let("gs", f"sort_array(concat({named('bl', 0)}, {named('sl', 1)}))", f"if(size(gs) = 0, cast(array() as {CANDIDATES}), {let('qs', begins, f'flatten(transform(qs, (q, k) -> {group}))')})")
    return let("sl", f"transform(ss, x -> {line})", f"if(exists(rs, x -> x.h.kind = 'open'), {both}, transform(sl, x -> {alone}))")


def running_max(values: str) -> str:
    """For each of an array of bigints, the largest before it (null where there is none)."""
    empty = "cast(array() as array<bigint>)"
    chunk = f"aggregate(slice(va, {CHUNK} * c + 1, {CHUNK}), named_struct('out', {empty}, 'm', acc.m), (b, v) -> named_struct('out', array_append(b.out, b.m), 'm', coalesce(greatest(b.m, v), b.m)))"
    step = let("z", chunk, "named_struct('out', array_append(acc.out, z.out), 'm', z.m)")
    zero = "named_struct('out', cast(array() as array<array<bigint>>), 'm', cast(null as bigint))"
    return let("va", values, f"if(size(va) = 0, {empty}, flatten(aggregate(sequence(0, (size(va) - 1) div {CHUNK}), {zero}, (acc, c) -> {step}).out))")


def _hunks() -> str:
    """Every hunk of a formatter's diffs, from rs; see hunks."""
    # parts begin at headers and hunks; those below a reader's own header count
    starts = f"filter(sequence(0, size(rs) - 1), i -> {_kind('get(rs, i)', 'head', 'close', 'hunk')})"
    heads = last_of("size(ks)", "transform(ks, p -> case get(rs, p).h.kind when 'head' then cast(p as string) when 'close' then '' end)", "hv")
    parts = "filter(transform(ks, (p, k) -> named_struct('p', p, 'e', coalesce(get(ks, k + 1), size(rs)), 'h', get(hs, k))), s -> s.h <> '')"
    facts = let("e0", "slice(rs, s.p + 1, s.e - s.p)", let("st", "get(filter(e0, x -> x.h.kind = 'stop'), 0).line_no", let("e", "filter(e0, x -> x.h.kind = 'stop' or st is null or x.line_no < st)", let(
        "gone", "get(filter(e, x -> x.h.kind = 'minus'), 0).line_no", let("new", "get(filter(e, x -> x.h.kind = 'plus'), 0).line_no", """named_struct('o', get(e, 0).h.kind, 'line_no', get(e, 0).line_no, 'begins', cast(get(e, 0).h.line as bigint), 'length', cast(get(e, 0).h.col as bigint),
 'name', get(rs, cast(s.h as int)).h.file, 'header', get(rs, cast(s.h as int)).line_no, 'stopped', st, 'gone', gone, 'last', get(reverse(filter(e, x -> x.h.kind in ('minus', 'plus'))), 0).line_no,
 'changed', cast(get(e, 0).h.line as bigint) + coalesce(gone, new, get(e, 0).line_no + 1) - get(e, 0).line_no - 1 - if(gone is null, 0, size(filter(e, x -> x.h.kind = 'plus' and x.line_no < gone))))""")))))
    sound = "g.o = 'hunk' and coalesce(g.begins > get(seen, i), true) and (g.gone is null or coalesce(g.changed < g.begins + coalesce(g.length, 1), false))"
    files = "filter(sequence(0, size(fs) - 1), i -> i = 0 or get(fs, i).header <> get(fs, i - 1).header)"
    row = _struct({
        "file": "g.g.name", "line": "if(g.ok, cast(g.g.changed as string), null)", "line_no": "g.g.line_no", "n": "0", "start": "g.g.header",
        "end": "if(g.ok, coalesce(least(g.g.stopped, g.next) - 1, g.g.last, g.g.line_no), g.g.header)",
    })
    one = let("g0", "slice(fs, q + 1, coalesce(get(qs, k + 1), size(fs)) - q)", let("seen", running_max("transform(g0, g -> g.begins)"), let(
        "gs", f"transform(g0, (g, i) -> named_struct('g', g, 'ok', coalesce({sound}, false), 'next', get(fs, q + i + 1).line_no))",
        let("some", "exists(gs, g -> g.ok)", f"transform(filter(gs, g -> g.ok or (g.g.o = 'head' and not some)), g -> {row})"))))
    out = let("fs", f"transform({parts}, s -> {facts})", f"if(size(fs) = 0, cast(array() as {CANDIDATES}), {let('qs', files, f'flatten(transform(qs, (q, k) -> {one}))')})")
    return let("ks", starts, f"if(size(ks) = 0, cast(array() as {CANDIDATES}), {let('hs', heads, out)})")


def _blocks(i: int, r: Reader) -> str:
    roles = blocks.roles(i, r)
    if r.block.hunks:
        return let("rs", _lines(roles[0]), f"if(size(rs) = 0, cast(array() as {CANDIDATES}), {_hunks()})")
    out = _sessions(r)
    if r.block.opens:
        lines = f"flatten(transform(ls, (text, line_no) -> transform({kept(f'array({", ".join(roles[1:])})')}, h -> named_struct('line_no', line_no, 'h', h))))"
        out = let("ss", lines, let("bl", out, _paired(r)))
    if r.block.events:
        line = _struct({f: f"x.h.{f}" for f in SAID} | {"line_no": "x.line_no", "n": "0", "start": "x.line_no", "end": "x.line_no"})
        out = f"concat({out}, transform(filter(rs, x -> x.h.kind = 'diagnostic'), x -> {line}))"
    return let("rs", _lines(roles[0]), out)


def _finished(found: str, reader: str, category: str, label: str, message: str) -> str:
    """What a reader said, made whole, in the order of its fields: title and numbers, and places, the lines that show it."""
    title = ", ".join(["x.code", "x.subject", "x.label" if label == "null" else f"coalesce(x.label, {label})", category])
    row = f"""named_struct('line_no', x.line_no, 'n', x.n, 'title', coalesce({title}), 'message', {T.collapsed(f"coalesce(x.message, {message}, '')")}, 'file', nullif(x.file, ''), 'line', if(ln >= 1, ln, null), 'col', if(ln >= 1 and cn >= 1, cn, null),
 'reader', {reader}, 'code', x.code, 'subject', x.subject, 'label', {"x.label" if label == "null" else f"coalesce(x.label, {label})"}, 'places', array(named_struct('start', x.start + 1, 'end', x.end + 1)))"""
    return f"transform({found}, x -> {let('ln', 'try_cast(x.line as int)', let('cn', 'try_cast(x.col as int)', row))})"


def _reader(i: int, r: Reader) -> str:
    """All that a reader says of the lines ls."""
    found = _blocks(i, r) if r.block else _single(r)
    graded = "severity" in {g for gs in (r.groups, *(a.split() for _, a in r.alts), (r.block or Block()).opens_groups) for g in gs}
    if graded:
        errors = f"in ({', '.join(T.quoted(e) for e in r.errors)})"
        # lower case letter by letter only for what isn't an error as it stands
        found = f"filter({found}, x -> if(coalesce(x.severity, '') {errors}, true, lower(coalesce(x.severity, '')) {errors}))"
    elif "" not in r.errors:
        found = f"filter({found}, x -> false)"
    text = lambda key: "null" if r.constants.get(key) is None else T.quoted(str(r.constants[key]))
    return _finished(found, str(i), T.quoted(r.category), text("label"), text("message"))


def gate(r: Reader) -> str:
    """Whether some line of raw may hold what makes the reader speak: one search of the whole text for what its lines would be searched for one by one."""
    if r.block and r.block.events:
        return "true"
    if r.block:
        return " or ".join(f"raw rlike {T.quoted('(?m)' + p)}" for p in dict.fromkeys((r.block.opens or r.pattern, r.pattern)))
    tries = [r.pattern, *(p for p, _ in r.alts)]
    # what looks around, or gives nothing back, may see further in a text than in its line
    if any(re.search(r"\(\?(?:[=!>]|<[=!])|[*+?}]\+", p) for p in tries):
        return "true"
    if all(p.startswith("^") for p in tries):
        return f"raw rlike {T.quoted('(?m)^(?:' + '|'.join(p[1:] for p in tries) + ')')}"
    return " or ".join(f"raw rlike {T.quoted('(?m)' + p)}" for p in tries)


def _dispatch(readers: tuple[Reader, ...], low: int, high: int, each) -> str:
    if high - low > 1:
        half = (low + high) // 2
        return f"if(r < {half}, {_dispatch(readers, low, half, each)}, {_dispatch(readers, half, high, each)})"
    return each(low, readers[low])


#: What a found failure has, besides ord; all of it is read, since a plan would make the array again for each of a part of its fields.
FOUND = ("reader", "file", "line", "col", "title", "message", "line_no", "code", "subject", "label", "places")
_KEY = ("reader", "file", "line", "col", "title", "message")


def merged_spans(spans: str) -> str:
    """Sorted line ranges, those that touch as one; the first eight."""
    # spans are sorted, so one beyond the first eight that touches none of them can't reach what is kept
    span = "if(size(acc) > 0 and s.start <= get(acc, size(acc) - 1).end + 1, array_append(slice(acc, 1, size(acc) - 1), named_struct('start', get(acc, size(acc) - 1).start, 'end', greatest(get(acc, size(acc) - 1).end, s.end))), if(size(acc) > 8, acc, array_append(acc, s)))"
    return f"slice(aggregate({spans}, cast(array() as {_SPANS}), (acc, s) -> {span}), 1, 8)"


def _merged() -> str:
    """The failures c of one reader in order, one for each place, title and message: the first, with the places of all."""
    key = ", ".join(f"'{k}', x.{k}" for k in _KEY)
    same = " and ".join(f"get(ks, i).{k} <=> get(ks, i - 1).{k}" for k in _KEY)
    places = merged_spans("sort_array(flatten(transform(g, y -> y.x.places)))")
    fields = ("line_no", "n", "title", "message", "file", "line", "col", "reader", "code", "subject", "label")
    one = f"named_struct({', '.join(f"'{f}', get(g, 0).x.{f}" for f in fields)}, 'places', {places})"
    group = let("g", "slice(ks, q + 1, coalesce(get(qs, k + 1), size(ks)) - q)", f"if(size(g) = 1, get(g, 0).x, {one})")
    exact = let("ks", f"sort_array(transform(c, x -> named_struct({key}, 'line_no', x.line_no, 'x', x)))", let("qs", f"filter(sequence(0, size(ks) - 1), i -> i = 0 or not ({same}))", f"transform(qs, (q, k) -> {group})"))
    # where no two hashes are equal, no two failures are
    once = f"if(size(c) = 1 or size(array_distinct(transform(c, x -> xxhash64({', '.join(f'x.{k}' for k in _KEY[1:])})))) = size(c), c, {exact})"
    return f"transform(sort_array({once}), (x, i) -> named_struct({', '.join(f"'{c}', x.{c}" for c in FOUND)}, 'ord', i + 1))"


def _merge(c: str, none: str = "array()") -> str:
    return let("c", c, f"if(size(c) = 0, {none}, {_merged()})")


def _documents(sources: tuple) -> str:
    """What documents said, made whole, from ds, those of one reader."""
    category = f"get(array({', '.join(T.quoted(s[2]) for s in sources)}), x.reader + {len(sources)})"
    cells = _struct({f: f"d.{f}" for f in FIELDS} | {"line_no": "d.line_no", "n": "d.n", "start": "d.line_no", "end": "greatest(d.line_no, coalesce(d.end_no, d.line_no))", "reader": "d.reader"})
    return _finished(f"transform(ds, d -> {cells})", "x.reader", category, "null", "null")


_SPOKEN = f"array<struct<reader:int,file:string,line:int,col:int,title:string,message:string,line_no:int,code:string,subject:string,label:string,places:{_SPANS},ord:int>>"


def order(readers: tuple[Reader, ...], hints: str) -> str:
    """The asked readers in the order in which they own a log (see ownership.first): by hint and position, a guess last; documents count as -1. hints: an array of (reader, hint)."""
    guess = {r.name: i for i, r in enumerate(readers)}.get("generic")
    plain = "concat(if(size(docs) = 0, array(), array(-1)), asked)"
    rank = f"named_struct('late', {'0' if guess is None else f'if(r = {guess}, 1, 0)'}, 'h', coalesce(array_min(filter(hs, h -> h.reader = r)).hint, {1 << 20}), 'r', r)"
    unmoved = f"size(hs) = 0 and not coalesce(array_contains(slice(asked, 1, greatest(size(asked) - 1, 0)), {-1 if guess is None else guess}), false)"
    return let("hs", hints, f"if({unmoved}, {plain}, transform(array_sort(transform({plain}, r -> {rank})), o -> o.r))")


def owned(readers: tuple[Reader, ...], sources: tuple) -> str:
    """An array of (FOUND, ord) of the failures of the reader that owns a row with raw, its lines ls, turns (see order) and docs, as SQL."""
    at = {r.name: i for i, r in enumerate(readers)}
    guess, build = at.get("generic"), at.get("docker")
    # that a build step failed is how the failure showed, not why: others are still asked, but for guesses
    late = "" if build is None else f" and ({'' if guess is None else f'r = {guess} or '}get(mine, 0).reader <> {build} or exists(mine, f -> not startswith(f.message, 'failed to solve: process ')))"
    document = let("ds", "filter(docs, d -> coalesce(d.severity, '') = '')", let("q", "array_min(transform(ds, d -> d.reader))", let("ds", "filter(ds, d -> d.reader = q)", _documents(sources))))
    found = f"if(r < 0, {document}, {_dispatch(readers, 0, len(readers), lambda i, r: f'if({gate(r)}, {_reader(i, r)}, array())')})"
    return f"aggregate(turns, cast(array() as {_SPOKEN}), (mine, r) -> if(size(mine) > 0{late}, mine, {_merge(found, 'mine')}))"


def failures(readers: tuple[Reader, ...], sources: tuple = ()) -> str:
    """An array of (FOUND, ord) of all failures of a row with raw and asked (and docs, what its documents say), as SQL."""
    said = f"transform(asked, r -> {_merge(_dispatch(readers, 0, len(readers), _reader))})"
    if sources:
        # a reader's failures are numbered on their own
        mine = "transform(array_distinct(transform(docs, d -> d.reader)), q -> filter(docs, d -> d.reader = q and coalesce(d.severity, '') = ''))"
        said = f"concat(if(size(docs) = 0, array(), transform({mine}, ds -> {_merge(_documents(sources))})), {said})"
    return let("ls", "split(raw, '\\n', -1)", f"flatten({said})")
