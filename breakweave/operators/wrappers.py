"""Prefixes that no gate knows: candidate texts of a log without them, each parsed, the best kept.

A log may be what several tasks wrote at once, each line with its task's name, or have one literal prefix on every line, in layers. A candidate takes one layer away: the lines of each
task together in the order in which tasks and lines came, or all lines less what they share. Every candidate is a log of its own to the readers, in the same pass; a candidate wins only if it
gives more located failures than the log as it is, or named ones where that gave none. Only logs that have a candidate are parsed more than once. Places are given in the lines of the log as
it came: each line of a candidate knows its number there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from . import within
from .parsing import normalised, once

#: A line's task: in brackets, before a bar, or package and script before a colon.
TASK = r"^(?:\[([\w@][\w@./:-]*)\] ?|([\w@][\w@./-]*) +\| ?|([\w@][\w@./-]*[:#][\w:-]+): ?)"
REST = r"([\s\S]*)"
#: What two lines begin with, and the first word or the indentation of it.
SHARED, WORD = r"^([^\n]*)[^\n]*\n\1", r"^(\s+|\S+\s)"
#: Words in brackets that are levels, not tasks.
LEVELS = ("info", "warn", "warning", "error", "debug", "trace", "fatal", "notice")
LAYERS, SHARE, MOST = 3, 0.6, 60
LINE = "array<struct<no:int,text:string>>"


def _numbered(raw: Column) -> Column:
    return F.transform(F.split(raw, "\n", -1), lambda x, i: F.struct(i.cast("int").alias("no"), x.alias("text")))


def _by_task(lines: str) -> str:
    """The lines of each task together, tasks in the order of their first line; a line without a task goes with the lines before all. Null unless enough lines name one."""
    levels = ", ".join(T.quoted(x) for x in LEVELS)
    name = "coalesce(nullif(get(m, 1), ''), nullif(get(m, 2), ''), nullif(get(m, 3), ''))"
    task = let("t", name, f"if(t is null or lower(t) in ({levels}), null, named_struct('name', t, 'rest', get(m, 4)))")
    named = f"transform({lines}, x -> named_struct('no', x.no, 'text', x.text, 't', {T.matched('x.text', TASK + REST, 4, task)}))"
    said = "filter(ns, x -> trim(x.text) <> '')"
    enough = let("said", said, f"size(said) > 0 and size(filter(said, x -> x.t is not null)) >= {SHARE} * size(said)")
    keyed = "transform(ns, x -> named_struct('task', array_position(ts, coalesce(x.t.name, '')), 'no', x.no, 'text', coalesce(x.t.rest, x.text)))"
    moved = let("ts", "array_distinct(transform(ns, x -> coalesce(x.t.name, '')))", f"transform(array_sort({keyed}), x -> named_struct('no', x.no, 'text', x.text))")
    return let("ns", named, f"if({enough}, {moved}, null)")


def _less_literal(lines: str) -> str:
    """The lines without the first word that all of them begin with, or their shared indentation, blank lines aside; null if that is under two characters, or for a single line."""
    # what the first and the last in order share, all share
    both = f"concat(left(array_min(said), {MOST}), '\\n', left(array_max(said), {MOST}))"
    # its first word and one blank, or its indentation: what the lines themselves begin with stays; more words are further layers
    same = f"length(regexp_extract(regexp_extract({both}, {T.quoted(SHARED)}, 1), {T.quoted(WORD)}, 1))"
    cut = f"transform({lines}, x -> named_struct('no', x.no, 'text', if(trim(x.text) = '', x.text, substr(x.text, same + 1))))"
    return let("said", f"filter(transform({lines}, x -> x.text), t -> trim(t) <> '')", f"if(size(said) > 1, {let('same', same, f'if(same >= 2, {cut}, null)')}, null)")


def candidates(logs: DataFrame, layers: int = LAYERS) -> DataFrame:
    """logs and their candidates: log_id names both, log is the log's own id, layer how many prefixes are gone, origin the log's line of each line (null where nothing moved)."""
    rows = once(normalised(logs.withColumn("log", F.col("log_id")), retries=False).withColumn("whole", F.col("raw")))
    # a line that came more than once shows what its lines share; its retries go when the candidate is parsed
    rows = rows.withColumn("raw", F.when(F.col("raw").contains("\n"), F.col("raw")).otherwise(F.col("whole"))).drop("whole")
    rows = rows.withColumn("l0", _numbered(F.col("raw")))
    for k in range(1, layers + 1):
        before = f"l{k - 1}"
        rows = rows.withColumn(f"l{k}", F.expr(f"if({before} is null, null, coalesce({_by_task(before)}, {_less_literal(before)}))"))
    made = F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.lit(k).alias("layer"), F.col(f"l{k}").alias("lines"))) for k in range(1, layers + 1))))
    asis = F.struct(F.lit(0).alias("layer"), F.lit(None).cast(LINE).alias("lines"))
    rows = rows.withColumn("c", F.explode(F.concat(F.array(asis), made)))
    lines = F.col("c.lines")
    return rows.select(
        *(c for c in logs.columns if c not in ("log_id", "raw")), "log", F.col("c.layer").alias("layer"), F.concat_ws("\u0001", F.col("c.layer").cast("string"), "log").alias("log_id"),
        F.when(lines.isNull(), F.col("raw")).otherwise(F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).alias("raw"), F.transform(lines, lambda x: x["no"]).alias("origin"),
    )


def best(tried: DataFrame, name: str) -> DataFrame:
    """(log_id, layers, first, said) of each log's best candidate, under the log's own id and lines; layers says how many prefixes it lost. tried: candidates with said, their failures, and first, the reader that owns them; name: the name of the reader of a failure f, as SQL."""
    known = F.expr(f"filter(said, f -> f.reader = first and {name} <> 'generic')")
    # of equal candidates the one with fewer layers gone, so that the log as it is stays unless another gains
    rows = tried.withColumn("known", known)
    # a filter over said would be pushed below it and make it again
    rows = rows.select("log", F.when(F.size("said") > 0, F.struct(F.expr("size(filter(known, f -> f.line is not null))").alias("located"), F.size("known").alias("known"), (-F.col("layer")).alias("less"), "first", "said", "origin")).alias("c"))
    # candidates meet by log once, with what was read of them alone
    rows = rows.groupBy("log").agg(F.max("c").alias("c")).select(F.col("log").alias("log_id"), (-F.col("c.less")).alias("layers"), "c.first", "c.said", "c.origin")
    lines = "array_sort(array_distinct(flatten(transform(f.places, p -> transform(sequence(p.start, p.end), k -> get(origin, k - 1) + 1)))))"
    cells = ", ".join(f"'{c}', " + (within.merged_spans(f"transform({lines}, k -> named_struct('start', k, 'end', k))") if c == "places" else f"f.{c}") for c in (*within.FOUND, "ord"))
    return rows.withColumn("said", F.expr(f"if(origin is null, said, transform(said, f -> named_struct({cells})))")).drop("origin")
