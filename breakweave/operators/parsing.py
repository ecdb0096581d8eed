"""From raw logs to failures: normalise, route, read, locate and deduplicate; lines are read where they lie, and only hits are shuffled, by log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from . import blocks, hunks, within
from .readers import READERS, Reader

CI_STAMP = r"^(?:[^\t\n]*\t){0,3}\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z ?"
#: Prefixes that CI systems and task runners put before each line.
WRAPPERS = (
    ("azure", r"^##\[\w+\]"), ("kubectl", r"^\[pod/[^\]]+\] "), ("buildkit", r"^#\d+ \d+\.\d+ "), ("turborepo", r"^[\w@/-]+:[\w-]+: "), ("jenkins", r"^\[\d{4}-\d{2}-\d{2}T[\d:.,]+Z?\] "), ("jenkins time", r"^\[\d{2}:\d{2}:\d{2}\] "),
    ("buildkite", r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] "), ("syslog", r"^[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2} \S+ "),
)

#: Whether any line opens with a stamp or a wrapper: without one, no gate can open.
MARKED = "(?m)^(?:" + "|".join(p[1:] for p in (CI_STAMP, *(p for _, p in WRAPPERS))) + ")"

#: Characters that most text is made of, twice: what is left of a text without the one or the other is short.
PLAIN = (("marks", "[a-z0-9 \n]+"), ("letters", "[^bdfgjkmpquvwxyz]+"))


def _gate(rate, share: float) -> Column:
    """The pattern that lines are to lose, by the share of first lines that each pattern finds; null if no gate opens."""
    wrapper = F.coalesce(*(F.when(rate(p) >= share, F.lit(p[1:])) for _, p in WRAPPERS), F.lit(""))
    stamp = F.when(rate(CI_STAMP) >= 0.8, F.lit(CI_STAMP[1:])).otherwise("")
    return F.nullif(F.concat(stamp, wrapper), F.lit(""))


def _prefix(head: Column, share: float) -> Column:
    """The pattern that lines are to lose, by the gates over the sampled lines; null if none opens."""
    return _gate(lambda p: F.size(F.filter(head, lambda x: x.rlike(p))) / F.greatest(F.size(head), F.lit(1)), share)


def _head(raw: Column, sample: int) -> Column:
    return F.slice(F.filter(F.slice(F.split(raw, "\n", -1), 1, 2 * sample), lambda x: F.trim(x) != ""), 1, sample)


def unframed(raw: Column) -> Column:
    """The lines of failing steps that a container build quotes between two rules, without their column of seconds; every line stays where it is."""
    parts = F.split(raw, r"(?m)^-{6,}[ \t]*$", -1)
    quoted = F.transform(parts, lambda x: F.when(x.rlike(r"^\n[ \t]*>[ \t]+\[[^\]\n]+\][ \t]+[^\n]*:[ \t]*\n"), F.regexp_replace(x, r"(?m)^\d+\.\d+[ \t]", "")).otherwise(x))
    return F.when(raw.rlike(r"(?m)^ERROR: (?:[\w .]+: )?failed to solve:"), F.array_join(quoted, "------")).otherwise(raw)


def normalised(logs: DataFrame, retries: bool = True) -> DataFrame:
    """logs with raw normalised: BOM, redrawn lines and escape sequences gone, line ends unified, quoted build steps bare, an exact retry kept once (unless retries is off).

    Where lines are redrawn by bare CRs, a CI prefix stands once a physical line, so it goes before the CRs become line ends.
    """
    logs = logs.withColumn("raw", T.strip_bom(F.coalesce("raw", F.lit(""))))
    raw = F.col("raw")
    only = lambda mark, change: F.when(mark, change).otherwise(raw)
    logs = logs.withColumn("raw", only(raw.contains("\u001b") | raw.contains("\u009b") | raw.contains("\u009d"), T.strip_ansi(T.drop_redraws(raw))))
    redrawn = F.when(raw.contains("\r"), F.when(raw.rlike(r"\r(?!\n)"), _prefix(_head(raw, 200), 0.4)))
    logs = logs.withColumn("redrawn", redrawn).withColumn("raw", only(F.col("redrawn").isNotNull(), F.regexp_replace("raw", F.concat(F.lit("(?dm)^(?:"), "redrawn", F.lit(")")), F.lit("")))).drop("redrawn")
    logs = logs.withColumn("raw", only(raw.contains("\r"), T.unix_lines(raw))).withColumn("raw", only(raw.contains("failed to solve:"), unframed(raw)))
    return once(logs) if retries else logs


def once(logs: DataFrame) -> DataFrame:
    """logs in which an exact retry of the whole output is kept once."""
    for sep in ("\n\n", "\n", "\n\n", "\n"):
        logs = logs.withColumn("raw", T.once(F.col("raw"), sep))
    return logs


def routed(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """Adds asked, the positions of the readers one of whose signals the log holds; readers without signals are always asked.

    What a text holds, its marks hold without their common characters (see PLAIN), and these are a small part of it, so most signals are looked for there alone.
    """
    few = len(readers) < 12  # so many signals that the two passes pay

    def held(signal: str) -> str:
        sparse = "" if few else "".join(f"contains({name}, {T.quoted(rest)}) and " for name, kind in PLAIN if (rest := re.sub(kind, "", signal)))
        return f"({sparse}contains(raw, {T.quoted(signal)}))"

    holds = lambda r: " or ".join(map(held, r.signals)) or "true"
    asked = f"array_compact(array({', '.join(f'if({holds(r)}, {i}, null)' for i, r in enumerate(readers))}))"
    # as columns, so that what looks for signals is compiled
    marks = {} if few else {name: F.regexp_replace("raw", kind, "") for name, kind in PLAIN}
    return logs.withColumns(marks).withColumn("asked", F.expr(asked)).drop(*marks)


def lines(logs: DataFrame, *keep: str) -> DataFrame:
    """(log_id, line_no, text) of every line, in order; a last empty line is kept."""
    return logs.select("log_id", *keep, F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "text"))


def gated(logs: DataFrame, share: float = 0.4, sample: int = 200) -> DataFrame:
    """Adds prefix, the pattern that each line of the log is to lose: a CI stamp that 80 % of its first lines carry, then the first wrapper that a share of them carry.

    The gates look at the first sample non-blank lines inside the row, so nothing is shuffled.
    """
    rows = logs.withColumn("head", F.when(F.col("raw").rlike(MARKED), _head(F.col("raw"), sample)))
    return rows.withColumn("prefix", F.when(F.col("head").isNotNull(), _prefix(F.col("head"), share))).drop("head")


def unwrapped(logs: DataFrame) -> DataFrame:
    """logs whose lines have lost their log's prefix, so that line starts and documents are where the tool put them."""
    bare = F.regexp_replace("raw", F.concat(F.lit("(?dm)^(?:"), "prefix", F.lit(")")), F.lit(""))
    return logs.withColumn("raw", F.when(F.col("prefix").isNull(), F.col("raw")).otherwise(bare)).drop("prefix")


def _roles(readers: tuple[Reader, ...], low: int, high: int) -> str:
    """Every role of text for reader r, one of those from low to high, as SQL: halved until one is left, so that a line pays for the readers that are asked alone."""
    if high - low > 1:
        half = (low + high) // 2
        return f"if(r < {half}, {_roles(readers, low, half)}, {_roles(readers, half, high)})"
    r = readers[low]
    if r.block:
        mine = blocks.roles(low, r)
    else:
        further = [("diagnostic", pattern, tuple(groups.split())) for pattern, groups in r.alts]
        mine = [blocks.when(low, kind, pattern, groups) for kind, pattern, groups in (("diagnostic", r.pattern, r.groups), *further, ("heading", r.heading, ("file",)), ("at", r.at, r.at_groups)) if pattern]
    return f"array({', '.join(mine)})"


def _finds(readers: tuple[Reader, ...], low: int, high: int) -> str:
    """Whether any pattern of reader r, one of those from low to high, finds something in text; readers of blocks are always tried."""
    if high - low > 1:
        half = (low + high) // 2
        return f"if(r < {half}, {_finds(readers, low, half)}, {_finds(readers, half, high)})"
    r = readers[low]
    return "true" if r.block else " or ".join(f"text rlike {T.quoted(p)}" for p in (r.pattern, *(p for p, _ in r.alts), r.heading, r.at) if p)


def hits(rows: DataFrame, readers: tuple[Reader, ...] = READERS, *keep: str) -> DataFrame:
    """(log_id, what is to be kept, line_no, hits): every role (reader, kind, fields, end_no, n) that a line has for an asked reader, and what documents say (docs, if the rows have it), of lines that have one.

    A log's lines are read within its row by one expression that the plan evaluates once: a filter over a column of hits would be pushed below it and read every line again.
    """
    each = f"transform(split(raw, '\\n', -1), (text, line_no) -> named_struct('line_no', line_no, 'hits', filter(flatten(transform(filter(asked, r -> {_finds(readers, 0, len(readers))}), r -> {_roles(readers, 0, len(readers))})), h -> h is not null)))"
    found = f"filter({each}, x -> size(x.hits) > 0)"
    if "docs" in rows.columns:
        cells = ", ".join(f"'{c}', d.{c}" for c in rows.schema["docs"].dataType.elementType.names if c != "line_no")
        found = f"concat({found}, transform(docs, d -> named_struct('line_no', d.line_no, 'hits', array(named_struct({cells})))))"
    return rows.select("log_id", *keep, F.explode(F.expr(found)).alias("x")).select("log_id", *keep, "x.line_no", "x.hits")


def narrowed(rows: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """Readers are asked only where a line may be theirs, those of blocks only where a block opens, since any line may be part of one."""
    mine = {i: g for i, r in enumerate(readers) if (g := within.gate(r)) != "true"}
    if not mine:
        return rows
    drop = f"array_compact(array({', '.join(f'if(array_contains(asked, {i}) and not ({g}), {i}, null)' for i, g in mine.items())}))"
    return rows.withColumn("asked", F.array_except("asked", F.expr(drop)))


def located(found: DataFrame, readers: tuple[Reader, ...] = READERS, sources: tuple = ()) -> DataFrame:
    """Failures in order: diagnostics with the heading above them and the place near them, blocks, and what documents say; only errors. found: hits, dealt by log.

    sources: (name, tool, category) of documents, whose rows count readers from -len(sources) on.
    """
    def index(f, g=lambda s: None) -> Column:
        return F.expr(f"get(array({', '.join(blocks.literal(x) for x in (*(g(s) for s in sources), *(f(r) for r in readers)))}), reader + {len(sources)})")

    kinds = ["diagnostic", "document"]
    rows = found
    none = F.lit(None).cast("struct<file:string,line:string,col:string,n:int>")
    extra = {"above": F.lit(None).cast("string"), "after": none, "before": none}
    single = [r for r in readers if not r.block]
    # the nearest place is a running last, forwards or backwards; at one line, diagnostics come first
    place = F.struct("file", "line", "col", F.col("line_no").alias("n"))
    last = lambda kind, x, order: F.last(F.when(F.col("kind") == kind, x), ignorenulls=True).over(Window.partitionBy("log_id", "reader").orderBy(order, F.col("kind") == "at").rowsBetween(Window.unboundedPreceding, -1))
    if any(r.heading for r in single):
        extra["above"] = last("heading", F.col("file"), F.col("line_no"))
    if any(r.reach < 0 for r in single):
        extra["before"] = last("at", place, F.col("line_no"))
    if any(r.reach > 0 for r in single):
        extra["after"] = last("at", place, F.col("line_no").desc())
    rows = rows.where(F.col("kind").isin(*kinds, "heading", "at")).withColumns(extra).where(F.col("kind").isin(kinds))
    reach, text = index(lambda r: r.reach), lambda key: index(lambda r: r.constants.get(key))
    near = F.when((reach > 0) & (F.col("after.n") - F.col("line_no") <= reach), F.col("after")).when((reach < 0) & (F.col("line_no") - F.col("before.n") <= -reach), F.col("before"))
    rows = rows.withColumn("near", near)
    file = F.coalesce("file", "near.file", F.when(index(lambda r: r.heading != "", lambda s: False), F.col("above")))
    rows = rows.select(
        "log_id", "reader", file.alias("file"), F.coalesce("line", "near.line").alias("line"), F.coalesce("col", "near.col").alias("col"), "code", "subject", "label", "severity", "message", "line_no", "n",
        F.least("line_no", F.coalesce("near.n", "line_no")).alias("start"), F.greatest("line_no", F.coalesce("near.n", "end_no", "line_no")).alias("end"),
    )
    if any(r.block and r.block.hunks for r in readers):
        rows = rows.unionByName(hunks.places(found, readers))
    if any(r.block and not r.block.hunks for r in readers):
        rows = rows.unionByName(blocks.paired(blocks.sessions(found, readers), found, readers))
    number = lambda c: F.expr(f"try_cast({c} as int)")
    positive = lambda c: F.when(c >= 1, c)
    rows = rows.select(
        "log_id", "reader", index(lambda r: r.name, lambda s: s[0]).alias("reader_name"), index(lambda r: r.tool, lambda s: s[1]).alias("tool"), index(lambda r: r.category, lambda s: s[2]).alias("category"),
        F.nullif("file", F.lit("")).alias("file"), positive(number("line")).alias("line"), positive(number("col")).alias("col"), "code", "subject", F.coalesce("label", text("label").cast("string")).alias("label"),
        F.lower(F.coalesce("severity", F.lit(""))).alias("severity"), T.collapse_repeats(F.coalesce("message", text("message").cast("string"), F.lit(""))).alias("message"), "line_no", "n",
        F.struct((F.col("start") + 1).cast("int").alias("start"), (F.col("end") + 1).cast("int").alias("end")).alias("evidence"),
    )
    errors = index(lambda r: ",".join(r.errors), lambda s: "")
    rows = rows.where(F.array_contains(F.split(errors, ","), F.col("severity"))).withColumn("severity", F.lit("error"))
    title = F.coalesce("code", "subject", "label", "category")
    return rows.withColumn("col", F.when(F.col("line").isNotNull(), F.col("col"))).withColumn("title", title)


KEY = ("log_id", "reader", "file", "line", "col", "title", "message")


def merged_spans(spans: Column, most: int = 8) -> Column:
    """Sorted line ranges, those that touch as one; the first most."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"] + 1), F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    return F.when(F.size(spans) == 1, spans).otherwise(F.slice(F.aggregate(spans, start, merge), 1, most))


def deduplicated(failures: DataFrame) -> DataFrame:
    """One failure for each place, title and message of a reader: the first; ord numbers them, places holds the evidence of all, merged."""
    rest = [c for c in failures.columns if c not in (*KEY, "evidence", "line_no")]
    rows = failures.groupBy(*KEY).agg(F.min("line_no").alias("line_no"), *(F.min_by(c, "line_no").alias(c) for c in rest), F.sort_array(F.collect_set("evidence")).alias("spans"))
    rows = rows.withColumn("places", merged_spans(F.col("spans"))).drop("spans")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("log_id", "reader").orderBy("line_no", "n", "title", "message"))).drop("n")


def parsed(logs: DataFrame, readers: tuple[Reader, ...] = READERS, documents=None) -> DataFrame:
    """Failures of all readers of all logs, and of the documents that documents reads (its SOURCES and found). logs: log_id, raw and, for command hints, argv.

    A log is a row, and what it says is found within it (see within): nothing is shuffled.
    """
    sources = documents.SOURCES if documents else ()
    return spread(whole(logs, readers, documents).select("log_id", F.inline(each("said"))), readers, sources)


def whole(logs: DataFrame, readers: tuple[Reader, ...] = READERS, documents=None) -> DataFrame:
    """logs with said, an array of their failures; raw is normalised."""
    rows = narrowed(unwrapped(gated(routed(normalised(logs), readers))), readers)
    if documents is not None:
        rows = documents.found(rows)
    said = F.expr(within.failures(readers, documents.SOURCES if documents else ()))
    return rows.withColumn("said", said).drop("asked", "docs")


def owned(logs: DataFrame, readers: tuple[Reader, ...], documents, hints: str) -> DataFrame:
    """logs with said, an array of the failures of the reader alone that owns the log; raw is normalised. hints: (reader, hint) of what the log says about its command, as SQL.

    The asked readers are tried in the order in which they own a log: one after the first that speaks would change nothing.
    """
    rows = documents.found(unwrapped(gated(routed(normalised(logs), readers))))
    rows = rows.withColumns({"ls": F.split("raw", "\n", -1), "turns": F.expr(within.order(readers, hints))})
    return rows.withColumn("said", F.expr(within.owned(readers, documents.SOURCES))).drop("asked", "docs", "ls", "turns")


def named(of, readers: tuple[Reader, ...], sources: tuple, at: str) -> str:
    """What of says of the reader, or document, at a position, as SQL."""
    return f"get(array({', '.join(blocks.literal(of(*x)) for x in (*sources, *((r.name, r.tool, r.category) for r in readers)))}), {at} + {len(sources)})"


def each(column: str):
    """An array to be inlined, as an expression: over a bare column the optimizer infers that it holds something, and makes it again to see."""
    return F.expr(f"transform({column}, f -> f)")


def spread(rows: DataFrame, readers: tuple[Reader, ...], sources: tuple, *more: str) -> DataFrame:
    """Failures with the names of their readers, from rows of log_id, what within found and more."""
    of = lambda n: F.expr(named(lambda *x: x[n], readers, sources, "reader"))
    return rows.select(
        "log_id", "reader", "file", "line", "col", "title", "message", "line_no", of(0).alias("reader_name"), of(1).alias("tool"), of(2).alias("category"),
        "code", "subject", "label", F.lit("error").alias("severity"), "places", "ord", *more,
    )


def read(rows: DataFrame, readers: tuple[Reader, ...], documents=None) -> DataFrame:
    """Failures of rows whose text is ready, by shuffled hits: log_id, raw, asked and, where a log has several rows, first, the number of its lines before this row."""
    first = ["first"] if "first" in rows.columns else []
    if documents is not None:
        rows = documents.found(rows)
    found = hits(rows, readers, *first)
    # only lines with hits are shuffled, once: all that follows groups by log; hits are spread after the shuffle, so that lone lines and blocks read the same one
    found = found.repartition("log_id").select("log_id", "line_no", *first, F.inline("hits"))
    if first:
        found = found.withColumns({c: (F.col(c) + F.col("first")).cast("int") for c in ("line_no", "end_no")}).drop("first")
    return deduplicated(located(found, readers, documents.SOURCES if documents else ()))
