"""The whole analysis as one plan, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..operators import clusters as C
from ..operators import documents, ownership, parsing, pieces, wrappers
from ..operators.readers import READERS, Reader
from ..operators.status import status

SHOWN = ("ord", "file", "line", "col", "title", "code", "subject", "label", "category", "severity", "message", "places")


def analysed(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """Failures of all logs with their role. logs: log_id, raw, argv."""
    return _spread(whole(logs, readers), readers)


def _spread(rows: DataFrame, readers: tuple[Reader, ...], *more: str) -> DataFrame:
    rows = rows.select("log_id", "first", *more, F.inline(parsing.each("said")))
    return parsing.spread(rows.withColumn("role", F.expr("if(reader = first, 'own', 'other')")), readers, documents.SOURCES, "role", *more)


def owned(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """analysed(logs) where role is own, for less: no reader is asked for what it would add."""
    rows = parsing.owned(logs, readers, documents, ownership.hints(readers) if "argv" in logs.columns else "array()")
    return parsing.spread(rows.select("log_id", F.inline(parsing.each("said"))), readers, documents.SOURCES, F.lit("own").alias("role"))


def whole(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """logs with said, their failures, and first, the reader that owns them: all of a log is found within its row."""
    rows = parsing.whole(logs, readers, documents)
    return rows.withColumn("first", F.expr(ownership.first(readers, documents.SOURCES, "argv" in logs.columns)))


def others(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """As ownership.secondaries of analysed, within each log's row: what other tools add."""
    rows = ownership.added(whole(logs, readers), readers, documents.SOURCES).select("log_id", F.inline(parsing.each("more")))
    return parsing.spread(rows, readers, documents.SOURCES, F.lit("other").alias("role"))


def analysed_chunks(chunks: DataFrame, readers: tuple[Reader, ...] = READERS, logs: DataFrame | None = None) -> DataFrame:
    """As analysed, of logs in many rows (log_id, chunk, raw), as sources.chunks reads them; logs (log_id, argv) says by what commands they came, where that is known."""
    return ownership.winners(pieces.parsed(chunks, readers, documents), None if logs is None else ownership.hinted(logs, readers))


def unwrapped(logs: DataFrame, readers: tuple[Reader, ...] = READERS, layers: int = wrappers.LAYERS) -> DataFrame:
    """As analysed, of logs whose lines may have prefixes of tasks or a shared beginning, up to so many layers; layers says how many of them were taken away."""
    tried = whole(wrappers.candidates(logs.select("log_id", "raw", "argv"), layers), readers)
    return _spread(wrappers.best(tried, parsing.named(lambda *x: x[0], readers, documents.SOURCES, "f.reader")), readers, "layers")


def reports(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """One row a log: tool, summary, failures, what other tools add, status and, without any failure, why there is none. logs: log_id, raw, argv, exit_code, signal."""
    rows = ownership.added(whole(logs.withColumn("empty", F.trim(F.coalesce("raw", F.lit(""))) == ""), readers), readers, documents.SOURCES)
    of = lambda n, at: parsing.named(lambda *x: x[n], readers, documents.SOURCES, at)
    shown = {"ord": "f.ord", "category": of(2, "f.reader"), "severity": "'error'"}
    own = f"transform(filter(said, f -> f.reader = first), f -> named_struct({', '.join(f"'{c}', {shown.get(c, f'f.{c}')}" for c in SHOWN)}))"
    tools = let("ts", f"transform(more, f -> {of(1, 'f.reader')})", "transform(sort_array(array_distinct(ts)), t -> named_struct('tool', t, 'count', cast(size(filter(ts, x -> x = t)) as bigint)))")
    rows = rows.selectExpr(
        "log_id", "exit_code", "signal", "empty", f"{of(1, 'first')} as tool", f"if({of(0, 'first')} = 'generic', 1, 0) as g", f"if(size(said) > 0, {own}, null) as failures", f"if(size(more) > 0, {tools}, null) as others",
    )
    return _shown(rows)


def reports_of(logs: DataFrame, found: DataFrame, pairs: int | None = None) -> DataFrame:
    """As reports, of failures that analysed found; where they were written to a table, ownership.PAIRS keeps logs with many failures from being compared pair by pair."""
    own = found.where("role = 'own'").groupBy("log_id").agg(F.min("tool").alias("tool"), F.max((F.col("reader_name") == "generic").cast("int")).alias("g"), F.sort_array(F.collect_list(F.struct(*SHOWN))).alias("failures"))
    more = ownership.secondaries(found, pairs).groupBy("log_id", F.col("tool").alias("t")).agg(F.count(F.lit(1)).alias("count")).groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("tool"), "count"))).alias("others"))
    rows = logs.select("log_id", "exit_code", "signal", (F.trim(F.coalesce("raw", F.lit(""))) == "").alias("empty")).join(own, "log_id", "left").join(more, "log_id", "left")
    return _shown(rows)


def _shown(rows: DataFrame) -> DataFrame:
    n = F.when(F.col("failures").isNotNull(), F.size("failures")).otherwise(0)
    return rows.select(
        "log_id", F.lit(1).alias("version"), "tool", F.when(n > 0, T.counted(n, "failure")).alias("summary"), (F.coalesce("g", F.lit(0)) == 1).alias("guessed"), "exit_code",
        status(F.col("exit_code"), F.col("signal")).alias("status"), F.when(n == 0, F.when(F.col("empty"), "no-output").otherwise("unrecognized-output")).alias("fallback"), "failures", "others",
    )


def to_json(report: DataFrame) -> DataFrame:
    """(log_id, json): every key of the root is present, absent facts of a failure are left out."""
    bare = F.to_json("failures")
    root = F.to_json(F.struct(*(F.col(c) for c in report.columns if c != "failures")), {"ignoreNullFields": "false"})
    return report.select("log_id", F.concat(F.substring(root, F.lit(1), F.length(root) - 1), F.lit(',"failures":'), F.coalesce(bare, F.lit("[]")), F.lit("}")).alias("json"))


def _escaped(text: Column, more: bool) -> Column:
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if more else ())):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def annotations(failures: DataFrame) -> DataFrame:
    """(log_id, ord, annotation): workflow-command lines for code hosts."""
    prop = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), _escaped(F.col(c).cast("string"), True)))
    props = F.concat_ws(",", prop("file", "file"), prop("line", "line"), prop("col", "col"), prop("title", "title"))
    return failures.select("log_id", "ord", F.concat(F.lit("::error "), props, F.lit("::"), _escaped(F.col("message"), False)).alias("annotation"))


def cause_report(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """Clusters of the own failures of all logs."""
    return C.clusters(analysed(logs, readers).where("role = 'own'"))
