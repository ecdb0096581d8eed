"""Failures that take a block of lines: opened by a line, held over what follows, closed by the next opening or closing line.

A line of a block has one role (kind): it opens or closes a block, opens a region in which alone blocks count, goes on with the name, is part of the message, ends it, names a place, or
switches the test that the next lines belong to. Only lines with a role become rows; they are numbered into blocks by a running count within their log and reader, and each block
is one group: no step takes time in the square of a log's lines, and a block's lines meet in one row only as far as they are message or name.

Interleaved output (several tests or packages at once) is keyed: what a line says belongs to the test named last, or by the line itself, within the segment that closing lines delimit.

Where a tool also prints one line a failure in its summary, summary lines and blocks are paired by name, the n-th with the n-th, each once; a summary line alone is a failure too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import hunks
from .readers import FIELDS, Block, Reader

EVENT = "struct<Action string, Package string, ImportPath string, Test string, Output string>"
#: What a test2json output line may hold: a place with a message, a compiler error, a panic.
_GO_PLACE, _GO_BUILD, _GO_PANIC, _GO_FRAME = r"^\s+([\w./\\-]+\.go):(\d+): ?(.*)$", r"^(?:\./)?([\w./\\-]+\.go):(\d+):(\d+): (.+)$", r"^panic: (.+?)(?:\s\[recovered.*\])?$", r"^\t(\S+_test\.go):(\d+)"


def struct(i: int, kind: str, known: dict[str, str], end: str = "null", n: str = "0", line: str = "") -> str:
    """A row of what a line is to a reader, as SQL: grammars are many, and an expression of many parts is far quicker to build from one string."""
    cells = [("line_no", line)] if line else []
    cells += [("reader", str(i)), ("kind", T.quoted(kind)), *((f, known.get(f, "cast(null as string)")) for f in FIELDS), ("end_no", f"cast({end} as int)"), ("n", f"cast({n} as int)")]
    return f"named_struct({', '.join(f'{T.quoted(k)}, {v}' for k, v in cells)})"


def groups_of(groups: tuple[str, ...]) -> dict[str, str]:
    """The named groups of a match (see text.matched): of groups of one name the first that took part."""
    got: dict[str, list[str]] = {}
    for n, g in enumerate(groups):
        got.setdefault(g, []).append(f"nullif(get(m, {n + 1}), '')")
    return {g: x[0] if len(x) == 1 else f"coalesce({', '.join(x)})" for g, x in got.items()}


def when(i: int, kind: str, pattern: str, groups: tuple[str, ...], text: str = "text") -> str:
    """The row of a line that the pattern finds, else null."""
    if not groups:
        return f"if({text} rlike {T.quoted(pattern)}, {struct(i, kind, {})}, null)"
    return T.matched(text, pattern, len(groups), struct(i, kind, groups_of(groups)))


def roles(i: int, r: Reader) -> list[str]:
    """What a line is to a reader of blocks: at most one of these in the order given, and a summary line beside it."""
    b = r.block
    if b.events:
        return [_event(i)]
    if b.hunks:
        return [f"coalesce({', '.join(when(i, kind, pattern, groups) for kind, pattern, groups in hunks.tries(r))})"]
    opens, groups = (b.opens, b.opens_groups) if b.opens else (r.pattern, r.groups)
    tries = [
        ("close", b.closes, ()), ("open", opens, groups), ("head", r.heading, ("file",)), ("region", b.region, ()), ("key", b.keys, ("subject",)), ("place", r.at, r.at_groups), ("stop", b.stop, ()),
        ("name", b.names, ("subject",)), ("say", b.says, ("message",)), ("spare", b.spare, ("message",)),
    ]
    out = [f"coalesce({', '.join(when(i, kind, pattern, groups) for kind, pattern, groups in tries if pattern)})"]
    if b.opens:
        out += [when(i, "summary", p, g) for p, g in ((r.pattern, r.groups), *((p, tuple(g.split())) for p, g in r.alts))]
    return out


def _event(i: int) -> str:
    """A test2json event: failed tests open blocks, output belongs to the test that the event names."""
    key = "concat_ws(' ', e.Package, e.Test)"
    part = lambda p, n: f"nullif(regexp_extract(e.said, {T.quoted(p)}, {n}), '')"
    said = [
        (_GO_PLACE, "place", {"label": key, "file": part(_GO_PLACE, 1), "line": part(_GO_PLACE, 2), "message": part(_GO_PLACE, 3)}),
        (_GO_BUILD, "diagnostic", {"label": "'go'", "file": part(_GO_BUILD, 1), "line": part(_GO_BUILD, 2), "col": part(_GO_BUILD, 3), "message": part(_GO_BUILD, 4)}),
        (_GO_PANIC, "say", {"label": key, "message": f"concat('panic: ', {part(_GO_PANIC, 1)})"}),
        (_GO_FRAME, "place", {"label": key, "file": part(_GO_FRAME, 1), "line": part(_GO_FRAME, 2)}),
    ]
    output = " ".join(f"when e.said rlike {T.quoted(p)} then {struct(i, kind, known)}" for p, kind, known in said)
    failed = f"if(e.Test is not null, {struct(i, 'open', {'subject': 'e.Test', 'label': key})}, null)"
    read = f"case when e.Action = 'fail' then {failed} when e.Action in ('output', 'build-output') then case {output} end end"
    event = f"transform(array(from_json(text, '{EVENT}')), v -> named_struct('Action', v.Action, 'Package', v.Package, 'Test', v.Test, 'said', rtrim('\n', v.Output)))"
    return f"""if(startswith(text, '{{') and contains(text, '"Action":"'), get(transform({event}, e -> {read}), 0), null)"""


def literal(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else T.quoted(str(value))


def _index(readers: tuple[Reader, ...], of) -> Column:
    return F.expr(f"get(array({', '.join(literal(of(r)) for r in readers)}), reader)")


def sessions(found: DataFrame, readers: tuple[Reader, ...]) -> DataFrame:
    """(log_id, reader, file, line, col, code, subject, label, severity, message, line_no, start, end) of every block, in rows of hits dealt by log."""
    mine = [i for i, r in enumerate(readers) if r.block and not r.block.hunks]
    of = lambda f: _index(readers, lambda r: f(r.block or Block()))
    kind = F.col("kind")
    rows = found.where(F.col("reader").isin(mine) & kind.isin("open", "close", "head", "region", "key", "place", "stop", "name", "say", "spare"))
    keyed = of(lambda b: bool(b.keys or b.events))
    by = Window.partitionBy("log_id", "reader").orderBy("line_no")
    cut = kind.isin("close", "region") | ((kind == "open") & ~keyed)
    rows = rows.select(
        "*", F.sum(cut.cast("int")).over(by).alias("block"), F.last(F.when(kind == "head", F.col("file")), ignorenulls=True).over(by).alias("above"),
        F.coalesce(F.max((kind == "region").cast("int")).over(by), F.lit(0)).alias("regions"), keyed.alias("keyed"),
        F.coalesce(F.max(kind == "key").over(Window.partitionBy("log_id", "reader")), F.lit(False)).alias("runs"),
        F.last(F.when(kind == "close", F.lit("")).when(kind.isin("key", "open"), F.coalesce("label", "subject")), ignorenulls=True).over(by).alias("named"),
    )
    key = F.when(kind == "open", F.coalesce("label", "subject")).otherwise(F.coalesce("label", "named"))
    rows = rows.withColumn("key", F.when(F.col("keyed"), key).otherwise(""))
    opened = kind == "open"
    rows = rows.withColumn("nth", F.lit(0))
    if any(r.block and (r.block.keys or r.block.events) for r in readers):
        # a test may fail several times: its lines follow its failure, or come before it where the output names tests as they run
        one = Window.partitionBy("log_id", "reader", "block", "key").orderBy("line_no")
        upto, every = F.sum(opened.cast("int")).over(one), F.sum(opened.cast("int")).over(Window.partitionBy("log_id", "reader", "block", "key"))
        runs = F.col("runs") | of(lambda b: b.events)
        nth = F.greatest(F.least(F.when(runs, upto - opened.cast("int")).otherwise(upto - 1), every - 1), F.lit(0))
        rows = rows.withColumn("nth", F.when(F.col("keyed"), nth).otherwise(0))
    at = F.struct("line_no", "file", "line", "col")
    clean = (kind == "place") & ~T.is_noise_path(F.col("file"))
    said = kind.isin("say", "place") & F.col("message").isNotNull()
    got = rows.groupBy("log_id", "reader", "block", "key", "nth").agg(
        F.min(F.when(opened, F.struct("line_no", *FIELDS, "above", "regions"))).alias("o"), F.min(F.when(clean, at)).alias("first_at"), F.max(F.when(clean, at)).alias("last_at"), F.min(F.when(kind == "stop", F.col("line_no"))).alias("stopped"),
        F.sort_array(F.collect_list(F.when(said, F.struct("line_no", "message")))).alias("said"), F.sort_array(F.collect_list(F.when(kind == "name", F.struct("line_no", "subject")))).alias("names"),
        F.max(F.when(kind == "spare", F.struct("line_no", "message"))).alias("spare"), F.max(F.when(kind.isin("open", "say", "place", "spare", "name"), F.col("line_no"))).alias("last"), F.min("line_no").alias("first"),
    ).where("o is not null")
    # as many blocks as the region's own count says are read elsewhere; here a block counts if its region has begun
    got = got.where(~of(lambda b: bool(b.region)) | (F.col("o.regions") > 0))
    lines = F.filter("said", lambda s: F.coalesce(s["line_no"] < F.col("stopped"), F.lit(True)))
    text = F.array_join(F.slice(F.transform(lines, lambda s: s["message"]), F.lit(1), of(lambda b: b.most)), "\n")
    more = F.transform(F.filter("names", lambda x, i: x["line_no"] == F.col("o.line_no") + i + 1), lambda x: x["subject"])
    subject = F.regexp_replace(F.array_join(F.concat(F.array("o.subject"), more), " "), ":$", "")
    place = F.when(of(lambda b: b.last), F.col("last_at")).otherwise(F.col("first_at"))
    message = F.coalesce(F.nullif(text, F.lit("")), "spare.message", "o.message")
    got = got.withColumn("place", place).withColumn("said_text", message).where(~of(lambda b: b.needs) | F.col("said_text").isNotNull() | F.col("place").isNotNull())
    within = of(lambda b: bool(b.keys or b.events))
    return got.select(
        "log_id", "reader", F.coalesce("place.file", "o.file", "o.above").alias("file"), F.coalesce("place.line", "o.line").alias("line"), F.coalesce("place.col", "o.col").alias("col"), "o.code", F.when(F.col("o.subject").isNotNull(), subject).alias("subject"),
        F.lit(None).cast("string").alias("label"), "o.severity", F.col("said_text").alias("message"), F.col("o.line_no").alias("line_no"), F.lit(0).alias("n"),
        F.when(within, F.least("o.line_no", F.coalesce("place.line_no", "o.line_no"))).otherwise(F.col("o.line_no")).alias("start"), F.when(within, F.greatest("o.line_no", F.coalesce("place.line_no", "o.line_no"))).otherwise(F.col("last")).alias("end"),
    )


def paired(blocks: DataFrame, found: DataFrame, readers: tuple[Reader, ...]) -> DataFrame:
    """Blocks and summary lines of one reader and log, the n-th of a name with the n-th: the block says where and what, the summary which test; each is used once."""
    mine = [i for i, r in enumerate(readers) if r.block and r.block.opens]
    if not mine:
        return blocks
    rest = [c for c in blocks.columns if c not in ("log_id", "reader")]
    log = Window.partitionBy("log_id", "reader")
    lines = found.where(F.col("reader").isin(mine) & F.col("kind").isin("summary", "open")).withColumn("opens", F.max(F.col("kind") == "open").over(log)).where("kind = 'summary'")
    lines = lines.select("log_id", "reader", *(F.col("line_no").alias(c) if c in ("start", "end") else F.col(c) for c in rest), "opens")
    # a log without blocks has nothing to pair
    alone = lines.where(~F.col("opens")).drop("opens").withColumn("subject", F.coalesce("subject", "file"))
    name = reduce(lambda text, p: F.regexp_replace(text, *p), ((r"^ERROR (?:collecting|at (?:setup|teardown) of) ", ""), ("::", ".")), F.coalesce("subject", "file"))
    both = blocks.where(F.col("reader").isin(mine)).withColumn("side", F.lit(0)).unionByName(lines.where("opens").drop("opens").withColumn("side", F.lit(1))).withColumn("name", name)
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("log_id", "reader", "name", "side").orderBy("line_no")))
    of = lambda side, label: F.max(F.when(F.col("side") == side, F.struct(*rest))).alias(label)
    met = both.groupBy("log_id", "reader", "name", "nth").agg(of(0, "b"), of(1, "s"))
    summary_first = {"severity", "label"}
    pick = lambda c: F.coalesce(f"s.{c}", f"b.{c}") if c in summary_first else F.coalesce(f"b.{c}", f"s.{c}")
    met = met.select("log_id", "reader", *((F.coalesce("s.subject", "name") if c == "subject" else pick(c)).alias(c) for c in rest))
    return met.select(*blocks.columns).unionByName(alone.select(*blocks.columns)).unionByName(blocks.where(~F.col("reader").isin(mine)))
