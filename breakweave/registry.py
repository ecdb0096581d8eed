"""Every registered query of the library, with its SQL.

Logs are rendered from lineitem, a log for each order and a diagnostic for each lineitem, in the tools' public formats; so the SQL can say from the
table what reading the logs must give back.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_queries, document_queries
from .functions import text as T
from .operators import capture, clusters, history, ownership, parsing, pieces
from .operators.readers import READERS, Reader
from .operators.status import CODES, SIGNALS, status
from .plans import report, summary
from .sources.logs import ITEMS, items, rendered, sample

BY_NAME = {r.name: r for r in READERS}
#: Tools whose formats no earlier reader also reads, for queries over logs of several tools.
MIXED = tuple(BY_NAME[n] for n in ("tsc", "pyright", "shellcheck", "cargo", "rspec"))


def _key(name: str) -> str:
    return "reader_" + re.sub(r"\W+", "_", name).strip("_")


def _reader_query(r: Reader):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = parsing.parsed(rendered(spark, sf_dir, (r,)), (r,))
        return found.select("log_id", "tool", "category", "file", "line", "col", "code", "subject", "label", "message")

    query.__name__ = _key(r.name)
    return query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _field_sql(r: Reader, name: str) -> str:
    """What a field of the reader must be, as SQL over the facts: by running the pattern over the sample's line in DuckDB."""
    sources = [(r.pattern, r.groups)] + ([(r.heading, ("file",))] if r.heading else []) + ([(r.at, r.at_groups)] if r.at else [])
    tries = []
    for pattern, groups in sources:
        for i, g in enumerate(groups):
            if g == name:
                for line in r.sample:
                    text = " || ".join(_quoted(x) if k % 2 == 0 else f"{x}" for k, x in enumerate(re.split(r"\{(\w+)\}", line)) if x)
                    tries.append(f"nullif(regexp_extract({text}, {_quoted(pattern)}, {i + 1}), '')")
    constant = r.constants.get(name)
    if constant is not None:
        tries.append(_quoted(str(constant)))
    return f"coalesce({', '.join(tries)})" if len(tries) > 1 else tries[0] if tries else "cast(null as varchar)"


def _reader_sql(r: Reader) -> str:
    f = {n: _field_sql(r, n) for n in ("file", "line", "col", "code", "subject", "label", "message")}
    return f"""with i as ({ITEMS})
select distinct cast(l_orderkey as varchar) as log_id, {_quoted(r.tool)} as tool, {_quoted(r.category)} as category, {f['file']} as file, cast({f['line']} as int) as line,
 case when {f['line']} is not null then cast({f['col']} as int) end as col, {f['code']} as code, {f['subject']} as subject, {f['label']} as label, coalesce({f['message']}, '') as message from i"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, MIXED, len(MIXED))


def _text_sql(r: Reader) -> str:
    """A rendered diagnostic of the reader, as SQL over the facts."""
    parts = re.split(r"\{(\w+)\}", "\n".join(r.sample))
    return " || ".join(_quoted(x) if k % 2 == 0 else x for k, x in enumerate(parts) if x)


_TOOL = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_quoted(r.tool)}" for i, r in enumerate(MIXED)) + " end"
_CODE = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_field_sql(r, 'code')}" for i, r in enumerate(MIXED)) + " end"
_SUBJECT = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_field_sql(r, 'subject')}" for i, r in enumerate(MIXED)) + " end"
_FILE = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_field_sql(r, 'file')}" for i, r in enumerate(MIXED)) + " end"
_COL = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_field_sql(r, 'col')}" for i, r in enumerate(MIXED)) + " end"
_MESSAGE = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_field_sql(r, 'message')}" for i, r in enumerate(MIXED)) + " end"
_CATEGORY = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_quoted(r.category)}" for i, r in enumerate(MIXED)) + " end"
#: The failures that the mixed logs must give.
OWN = f"(select distinct cast(l_orderkey as varchar) as log_id, {_TOOL} as tool, {_CATEGORY} as category, {_FILE} as file, cast(line as int) as line, cast({_COL} as int) as col, {_CODE} as code, {_SUBJECT} as subject, {_MESSAGE} as message from ({ITEMS}))"
_SHAPE = r"regexp_replace(message, '\d+(\.\d+)?', '<num>', 'g')"
_CAUSE = f"""substr(sha256('["' || coalesce(code, '') || '","' || {_SHAPE} || '"]'), 1, 24)"""


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.analysed(mixed(spark, sf_dir), MIXED).where("role = 'own'")


def failures(spark, sf_dir):
    """Winner of each log and its failures."""
    return _own(spark, sf_dir).select("log_id", "tool", "category", "file", "line", "col", "code", "subject", "message")


def flagship(spark, sf_dir):
    """The report's headline of each log."""
    rows = report.reports(mixed(spark, sf_dir))
    return rows.select("log_id", "version", "tool", "summary", "guessed", "exit_code", "fallback", F.size("failures").alias("n_failures"))


def json_report(spark, sf_dir):
    """The report as JSON: tool and count of failures read back from it."""
    rows = report.to_json(report.reports(mixed(spark, sf_dir), MIXED))
    return rows.select("log_id", F.get_json_object("json", "$.tool").alias("tool"), F.size(F.from_json(F.get_json_object("json", "$.failures"), "array<struct<ord int>>")).alias("n_failures"))


def annotations(spark, sf_dir):
    return report.annotations(_own(spark, sf_dir)).select("log_id", "annotation")


def cluster_sizes(spark, sf_dir):
    """Reported clusters of each log: cause, shape and size."""
    rows = report.cause_report(mixed(spark, sf_dir), MIXED).where("reported")
    return rows.select("log_id", "tool", "id", "signature", "size")


def causes(spark, sf_dir):
    return clusters.causes(_own(spark, sf_dir)).select("tool", "cause", "signature", "failures", "logs")


def rollup(spark, sf_dir):
    return clusters.rollup(_own(spark, sf_dir))


def history_compare(spark, sf_dir):
    """Causes of this run that are new, still there or gone, an identity for each tool: even orders are the previous run, odd ones this."""
    rows = clusters.keyed(_own(spark, sf_dir)).select(F.col("tool").alias("identity"), "cause", "log_id")
    return history.compared_runs(rows, F.col("log_id").cast("long") % 2 == 1)


def command_hints(spark, sf_dir):
    """The command moves its readers to the front: the hinted readers of each argv."""
    logs = items(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("log_id"), F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("python"), F.lit("-m"), F.lit("pytest"))).otherwise(F.array(F.lit("/usr/bin/tsc"))).alias("argv")).distinct()
    return ownership.hinted(logs).select("log_id", F.get(F.array(*(F.lit(r.name) for r in READERS)), F.col("reader")).alias("reader"), "hint")


def secondaries(spark, sf_dir):
    """Logs in which further tools speak: what they say that the first did not. Pyright repeats the first tool's failures in even orders and says something else about the same places in odd ones."""
    says = F.when(F.col("l_orderkey") % 2 == 0, F.col("message")).otherwise("another finding")
    again = F.concat(F.lit("  "), "file", F.lit(":"), "line", F.lit(":"), "col", F.lit(" - error: "), says)
    texts = (sample(BY_NAME["shellcheck"]), again, sample(BY_NAME["tsc"]))
    logs = items(spark, sf_dir).groupBy("l_orderkey").agg(*(F.collect_list(t).alias(f"t{i}") for i, t in enumerate(texts)))
    raw = F.array_join(F.concat("t0", "t1", "t2"), "\n")
    logs = logs.select(F.col("l_orderkey").cast("string").alias("log_id"), raw.alias("raw"), F.lit(None).cast("array<string>").alias("argv"))
    return report.others(logs, tuple(BY_NAME[n] for n in ("shellcheck", "pyright", "tsc"))).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def secondaries_large(spark, sf_dir):
    """Logs of 20,000 orders, in which another tool repeats every line item: at its place, without a place, or in or beside the lines that said it first. What is beside them remains."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("kind", F.expr("if(l_linenumber % 3 = 2, 2 + l_orderkey % 2, l_linenumber % 3)"))
    facts = ["cast(l_orderkey div 20000 as string) as log_id", "cast(l_linenumber as int) as ord", "cast(l_linenumber as int) as line", "cast(null as int) as col", "cast(null as string) as title", "cast(null as string) as code", "'s' as subject", "cast(null as string) as label"]
    said = "concat('order ', l_orderkey, ' line ', l_linenumber, ' is late')"
    place = "array(named_struct('start', cast(2 * l_linenumber as int) + {0}, 'end', cast(2 * l_linenumber as int) + {0})) as places"
    own = rows.selectExpr(*facts, "0 as reader", "'a' as reader_name", "'a' as tool", "'own' as role", "concat('f', l_orderkey, '.c') as file", f"{said} as message", place.format(0))
    other = rows.selectExpr(*facts, "1 as reader", "'b' as reader_name", "'b' as tool", "'other' as role", "case when kind = 0 then concat('/x/f', l_orderkey, '.c') when kind > 1 then concat('o', l_orderkey, '.c') end as file", f"if(kind = 1, concat(l_orderkey, ' line ', l_linenumber, ' is'), {said}) as message", place.format("if(kind = 3, 1, 0)"))
    return ownership.secondaries(own.unionByName(other), ownership.PAIRS).select("log_id", "file", "line", "message")


#: What stands around diagnostics in captured logs; no reader may take it for a failure.
BEFORE = "$ ./ci.sh check\nFetching 12 packages\n> web@1.4.0 check\n\ninfo: 3 files in cache\nNote: 0 errors in the last run\n"
AFTER = "\n\nDone in 2.31s.\nUploading 4 artifacts, 0 failed\nProcess ended with code 1\n"


def failures_in_noise(spark, sf_dir):
    """Winner and failures of logs with other output around the diagnostics, all readers and documents on."""
    logs = mixed(spark, sf_dir).withColumn("raw", F.concat(F.lit(BEFORE), "raw", F.lit(AFTER)))
    return report.analysed(logs).where("role = 'own'").select("log_id", "tool", "category", "file", "line", "col", "code", "subject", "message")


def wrapped_logs(spark, sf_dir):
    """Failures of logs whose lines carry a prefix: two tasks writing in turn in even orders, one literal in odd ones (but for logs of a line, which share nothing)."""
    lines = F.split("raw", "\n", -1)
    even, odd = F.transform(lines, lambda x: F.concat(F.lit("api-1  | "), x, F.lit("\nweb-1  | listening"))), F.transform(lines, lambda x: F.concat(F.lit("ci> "), x))
    logs = mixed(spark, sf_dir).withColumn("raw", F.array_join(F.when((F.col("log_id").cast("long") % 2 == 0) | (F.size(lines) == 1), even).otherwise(odd), "\n"))
    rows = report.unwrapped(logs, MIXED, 1).where("role = 'own'")
    return rows.select("log_id", "tool", "category", "file", "line", "col", "code", "subject", "message", "layers")


def top_causes(spark, sf_dir):
    """The first three causes of each log in order of size."""
    rows = summary.ordered(report.cause_report(mixed(spark, sf_dir), MIXED), 3).where("shown")
    return rows.groupBy("log_id").agg(F.max("rank").alias("shown"), F.max("size").alias("largest"), F.max(F.when(F.col("rank") == 1, F.col("size"))).alias("first_size"))


def cause_sites(spark, sf_dir):
    """Cases and places of each cause of a log."""
    return summary.sites(_own(spark, sf_dir)).select("log_id", "cause", "cases", "sites", F.get("first_sites", 0).alias("first_site"), "headline")


def markdown(spark, sf_dir):
    """The report as markdown, of logs of a linter."""
    logs = rendered(spark, sf_dir, (BY_NAME["flake8"],))
    return summary.markdown(report.reports(logs, (BY_NAME["flake8"],)), 2)


def raw_fallback(spark, sf_dir):
    """The beginning of an unread log as one annotation within 300 bytes."""
    logs = rendered(spark, sf_dir, (BY_NAME["tsc"],))
    return summary.raw_fallback(logs.withColumn("raw", F.concat(F.lit("100% café\n"), "raw")), 300)


def tallies(spark, sf_dir):
    """Failures that logs declare against those read; every third order declares one more."""
    logs = rendered(spark, sf_dir, (BY_NAME["tsc"],))
    n = F.size(F.split("raw", "\n")) + (F.col("log_id").cast("long") % 3 == 0).cast("int")
    logs = logs.withColumn("raw", F.concat("raw", F.lit("\nFound "), n.cast("string"), F.lit(" errors in 3 files.\n")))
    return summary.tallies(logs, report.analysed(logs, (BY_NAME["tsc"],)).where("role = 'own'"))


def run_history(spark, sf_dir):
    """Records of runs, a name for each log: how many causes each tracks."""
    logs = mixed(spark, sf_dir).withColumn("run_key", F.when(F.col("log_id").cast("long") % 4 != 0, F.concat(F.lit("job-"), "log_id"))).withColumn("cwd", F.lit("/w"))
    own = report.analysed(logs, MIXED).where("role = 'own'")
    rows = history.records(history.tracked(own, history.identity(logs)), F.lit("2024-01-01 00:00:00"))
    return rows.select("identity", "version", "tool", F.size("causes").alias("n_causes"))


def snippets(spark, sf_dir):
    """Source lines around each failure; the sources have six lines, the second of them blank."""
    parts = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").select((F.col("p_partkey") % 50).alias("k")).distinct()
    sources = parts.select(F.concat(F.lit("src/m"), F.col("k").cast("string"), F.lit(".ts")).alias("path"), F.lit("one\n\nthree\nfour\nfive\nsix").alias("text"))
    found = report.analysed(rendered(spark, sf_dir, (BY_NAME["tsc"],)), (BY_NAME["tsc"],))
    return summary.snippets(found, sources).select("log_id", "file", "line", "col", "message", "has_line", "snippet")


def normalise(spark, sf_dir):
    """Colour, CR and CI stamps around the lines go; the failures stay."""
    logs = rendered(spark, sf_dir, (BY_NAME["tsc"],))
    dressed = F.concat(F.lit("﻿2024-01-02T03:04:05.678Z \u001b[31m"), F.regexp_replace("raw", "\n", "\u001b[0m\r\n2024-01-02T03:04:05.678Z \u001b[31m"), F.lit("\u001b[0m"))
    return parsing.parsed(logs.withColumn("raw", dressed), (BY_NAME["tsc"],)).select("log_id", "file", "line", "col", "code", "message")


def exact_retry(spark, sf_dir):
    """A log that is the same output twice counts once."""
    logs = rendered(spark, sf_dir, (BY_NAME["tsc"],))
    return parsing.normalised(logs.withColumn("raw", F.concat("raw", F.lit("\n\n"), "raw"))).select("log_id", F.md5("raw").alias("raw_md5"))


def build_steps(spark, sf_dir):
    """What failed inside a step of a container build, quoted between rules with a column of seconds; the build's own last line does not own the log."""
    logs = rendered(spark, sf_dir, (BY_NAME["npm"],))
    quoted = F.concat(F.lit("#7 ERROR: process\n------\n > [4/4] RUN npm test:\n0.231 "), F.regexp_replace("raw", "\n", "\n0.245 "), F.lit('\n------\nDockerfile:8\nERROR: failed to solve: process "/bin/sh -c npm test" did not complete successfully: exit code: 1\n'))
    found = report.analysed(logs.withColumn("raw", quoted), tuple(BY_NAME[n] for n in ("docker", "npm"))).where("role = 'own'")
    return found.select("log_id", "tool", "category", "file", "line", "col", "code", "subject", "label", "message")


def router(spark, sf_dir):
    """How many logs each reader would be asked for."""
    rows = parsing.routed(mixed(spark, sf_dir)).select(F.explode("asked").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("logs"))
    names = F.get(F.array(*(F.lit(r.name) for r in READERS)), F.col("r"))
    return rows.select(names.alias("reader"), "logs")


def bounded_capture(spark, sf_dir):
    """Lines kept of each order's log under a budget of 400 characters."""
    lined = parsing.lines(rendered(spark, sf_dir, (BY_NAME["tsc"],)).withColumn("raw", F.concat_ws("\n", *["raw"] * 4)))
    return capture.captured(lined.withColumn("text", F.regexp_replace("text", "error", "note")), 400, 2).groupBy("log_id").agg(F.count(F.lit(1)).alias("kept"), F.max("truncated").alias("truncated"))


def elided_capture(spark, sf_dir):
    """The same with markers: how many runs of lines each order's log lost, and how many characters."""
    lined = parsing.lines(rendered(spark, sf_dir, (BY_NAME["tsc"],)).withColumn("raw", F.concat_ws("\n", *["raw"] * 4)))
    rows = capture.elided(lined.withColumn("text", F.regexp_replace("text", "error", "note")), 400, 2)
    return rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("elided") > 0).alias("gaps"), F.sum("elided").alias("elided"))


def chunked_failures(spark, sf_dir):
    """Failures of logs of a thousand orders, stamped by a CI system and cut into rows of 50 lines, with the lines where they stand in the whole log."""
    logs = rendered(spark, sf_dir, (BY_NAME["tsc"],)).groupBy(F.floor(F.col("log_id").cast("long") / 1000).cast("string").alias("log_id"))
    lined = logs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("log_id").cast("long").alias("o"), "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    stamped = lined.withColumn("raw", F.regexp_replace("raw", "(?m)^", "2024-05-01T10:00:00.0000000Z "))
    found = report.analysed_chunks(pieces.cut(stamped, 50), (BY_NAME["tsc"],)).where("role = 'own'")
    return found.select("log_id", "tool", "file", "line", "col", "code", "message", F.col("places")[0]["start"].alias("at"))


def exit_status(spark, sf_dir):
    """Exit codes in words, the codes from order keys."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select((F.col("o_orderkey") % 160).cast("int").alias("code")).distinct()
    return rows.select("code", status(F.col("code"), F.lit(None).cast("string"))["says"].alias("says"))


def skeletons(spark, sf_dir):
    """Shapes of messages and how often they come."""
    return items(spark, sf_dir).select(T.skeleton(F.col("message")).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def repeats(spark, sf_dir):
    """Runs of equal lines collapse."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 6 + 1).cast("int").alias("k"))
    return rows.select("o_orderkey", T.collapse_repeats(F.concat(F.lit("a\n"), F.expr("array_join(array_repeat('same', k), '\n')"), F.lit("\nb"))).alias("message"))


_TEXT = "case " + " ".join(f"when l_orderkey % {len(MIXED)} = {i} then {_text_sql(r)}" for i, r in enumerate(MIXED)) + " end"
_HOLDS = {r.name: " or ".join(f"contains(raw, {_quoted(x)})" for x in r.signals) or "true" for r in READERS}
_ASKED = ", ".join(f"{{'reader': {_quoted(name)}, 'asked': {holds}}}" for name, holds in _HOLDS.items())
_STATUS = " ".join([*(f"when code = {n + 128} then 'killed by {s}'" for n, s in SIGNALS.items()), *(f"when code = {n} then {_quoted(s)}" for n, s in CODES.items())])
_TSC = f"{ITEMS}"
_ENTRIES = {
    "report": (flagship, f"select log_id, 1 as version, tool, count(*) || ' failure' || case when count(*) = 1 then '' else 's' end as summary, false as guessed, 1 as exit_code, cast(null as varchar) as fallback, cast(count(*) as int) as n_failures from {OWN} group by log_id, tool"),
    "failures": (failures, f"select * from {OWN}"),
    "json_report": (json_report, f"select log_id, tool, cast(count(*) as int) as n_failures from {OWN} group by all"),
    "annotations": (annotations, f"select log_id, '::error file=' || file || ',line=' || line || coalesce(',col=' || col, '') || ',title=' || coalesce(code, subject) || '::' || message as annotation from {OWN}"),
    "cluster_sizes": (cluster_sizes, f"select log_id, tool, {_CAUSE} as id, {_SHAPE} as signature, cast(count(*) as int) as size from {OWN} group by all having count(*) >= 3"),
    "causes": (causes, f"select tool, {_CAUSE} as cause, {_SHAPE} as signature, count(*) as failures, count(distinct log_id) as logs from {OWN} group by all"),
    "rollup": (rollup, f"select category, tool, count(*) as failures from {OWN} group by rollup(category, tool)"),
    "history_compare": (history_compare, f"with k as (select distinct tool as identity, {_CAUSE} as cause, cast(log_id as bigint) % 2 = 1 as now from {OWN}), g as (select identity, cause, bool_or(now) as n, bool_or(not now) as t from k group by 1, 2) select identity, count(*) filter (n and not t) as fresh, count(*) filter (n and t) as same, count(*) filter (t and not n) as gone from g group by 1"),
    "command_hints": (command_hints, "with k as (select distinct l_orderkey from lineitem) select cast(l_orderkey as varchar) as log_id, r as reader, h as hint from k join (values (0, 'pytest', 2), (0, 'python', 0), (1, 'tsc', 0)) v(m, r, h) on l_orderkey % 2 = m"),
    "secondaries_large": (secondaries_large, "select distinct cast(l_orderkey // 20000 as varchar) as log_id, 'o' || l_orderkey || '.c' as file, cast(l_linenumber as int) as line, 'order ' || l_orderkey || ' line ' || l_linenumber || ' is late' as message from lineitem where l_linenumber % 3 = 2 and l_orderkey % 2 = 1"),
    "secondaries": (secondaries, f"select 'pyright' as tool, count(*) as n from (select distinct l_orderkey, file, line, col from ({ITEMS}) where l_orderkey % 2 = 1) having count(*) > 0 union all select 'tsc' as tool, count(*) as n from (select distinct l_orderkey, file, line, col, message from ({ITEMS})) having count(*) > 0"),
    "wrapped_logs": (wrapped_logs, f"select *, 1 as layers from {OWN}"),
    "failures_in_noise": (failures_in_noise, f"select * from {OWN}"),
    "top_causes": (top_causes, f"with k as (select log_id, {_CAUSE} as c, count(*) as n from {OWN} group by all), u as (select log_id, sum(case when n >= 3 then 1 else n end) as units, max(case when n >= 3 then n else 1 end) as largest from k group by 1) select log_id, cast(least(units, 3) as int) as shown, cast(largest as int) as largest, cast(largest as int) as first_size from u"),
    "cause_sites": (cause_sites, f"with k as (select log_id, {_CAUSE} as cause, count(*) as cases, count(distinct concat_ws(':', file, line, col)) as sites, min(concat_ws(':', file, line, col)) as first_site from {OWN} group by all) select log_id, cause, cases, cast(sites as int) as sites, first_site, case when sites = cases then sites || ' site' || case when sites = 1 then '' else 's' end else cases || ' cases at ' || sites || ' site' || case when sites = 1 then '' else 's' end end as headline from k"),
    "markdown": (markdown, f"""with i as (select distinct l_orderkey, '**E' || line || '00** `' || file || ':' || line || ':' || col || '`' || chr(10) || '```text' || chr(10) || message || chr(10) || '```' as part, line, file, col, message from ({ITEMS})),
 r as (select l_orderkey, part, row_number() over (partition by l_orderkey order by line, file, col, message) as n, count(*) over (partition by l_orderkey) as c from i),
 g as (select l_orderkey, max(c) as c, string_agg(part, chr(10) || chr(10) order by n) filter (n <= 2) as head, string_agg(part, chr(10) || chr(10) order by n) filter (n > 2) as tail from r group by 1)
select cast(l_orderkey as varchar) as log_id, '## flake8: ' || c || ' failure' || case when c = 1 then '' else 's' end || chr(10) || chr(10) || head || case when c > 2 then chr(10) || chr(10) || '<details><summary>' || (c - 2) || ' more</summary>' || chr(10) || chr(10) || tail || chr(10) || chr(10) || '</details>' else '' end as markdown from g"""),
    "raw_fallback": (raw_fallback, f"""with g as (select l_orderkey, '100% café' || chr(10) || string_agg({_text_sql(BY_NAME['tsc'])}, chr(10) order by line, file, col, message, code) as raw from ({ITEMS}) group by 1),
 k as (select l_orderkey, raw, list_max(list_filter(range(0, length(raw) + 1), lambda n: strlen(replace(replace(left(raw, n), '%', '%25'), chr(10), '%0A')) <= 300 - 34 - 20 - 1)) as n from g)
select cast(l_orderkey as varchar) as log_id, '::notice title=captured output::' || replace(replace(left(raw, n), '%', '%25'), chr(10), '%0A') || case when n < length(raw) then ' [preview truncated]' else '' end as annotation, n < length(raw) as cut from k""".replace("300 - 34 - 20 - 1", str(300 - len("::notice title=captured output::") - len(" [preview truncated]") - 1))),
    "tallies": (tallies, f"select cast(l_orderkey as varchar) as log_id, count(*) + (l_orderkey % 3 = 0)::int as declared, count(distinct (file, line, col, message)) as found, count(*) + (l_orderkey % 3 = 0)::int > count(distinct (file, line, col, message)) as unread from ({ITEMS}) group by l_orderkey"),
    "run_history": (run_history, f"select substr(sha256('6:job-' || log_id), 1, 24) as identity, 6 as version, tool, cast(count(distinct {_CAUSE}) as int) as n_causes from {OWN} where cast(log_id as bigint) % 4 <> 0 group by log_id, tool"),
    "snippets": (snippets, f"""with s as (select distinct 'src/m' || (p_partkey % 50) || '.ts' as path from part), f as (select distinct l_orderkey, file || '.ts' as file, cast(line as int) as line, cast(col as int) as col, message from ({ITEMS}))
select cast(l_orderkey as varchar) as log_id, file, line, col, message, case when path is not null then line <= 6 end as has_line,
 case when path is null or line > 6 then null when line = 1 then '> 1 | one' else array_to_string(list_transform(case when line = 2 then [1, 2, 3, 4, 5, 6] else [3, 4, 5, 6] end, lambda n: case when n = line then '> ' else '  ' end || n || ' | ' || (['one', '', 'three', 'four', 'five', 'six'])[n]), chr(10)) end as snippet
from f left join s on file = path"""),
    "normalise": (normalise, f"select distinct cast(l_orderkey as varchar) as log_id, file || '.ts' as file, cast(line as int) as line, cast(col as int) as col, 'TS' || line as code, message from ({_TSC})"),
    "exact_retry": (exact_retry, f"select cast(l_orderkey as varchar) as log_id, md5(string_agg(file || '.ts(' || line || ',' || col || '): error TS' || line || ': ' || message, chr(10) order by line, file, col, message, code)) as raw_md5 from ({_TSC}) group by l_orderkey"),
    "build_steps": (build_steps, _reader_sql(BY_NAME["npm"])),
    "router": (router, f"with i as ({ITEMS}), g as (select l_orderkey, string_agg({_TEXT}, chr(10)) as raw from i group by 1), c as (select unnest([{_ASKED}]) as a from g) select a.reader as reader, count(*) as logs from c where a.asked group by 1"),
    "bounded_capture": (bounded_capture, f"""with l as (select l_orderkey, k, line, file, col, message, code, length(file || '.ts(' || line || ',' || col || '): note TS' || line || ': ' || message) + 1 as s from ({ITEMS}), range(4) t(k)),
 w as (select *, sum(s) over (partition by l_orderkey order by k, line, file, col, message, code rows unbounded preceding) as h, sum(s) over (partition by l_orderkey) as t from l)
select cast(l_orderkey as varchar) as log_id, count(*) as kept, max(t) > 400 as truncated from w where t <= 400 or h <= 100 or t - h + s <= 200 group by l_orderkey"""),
    "elided_capture": (elided_capture, f"""with l as (select l_orderkey, k, line, file, col, message, code, length(file || '.ts(' || line || ',' || col || '): note TS' || line || ': ' || message) + 1 as s from ({ITEMS}), range(4) t(k)),
 w as (select *, sum(s) over (partition by l_orderkey order by k, line, file, col, message, code rows unbounded preceding) as h, sum(s) over (partition by l_orderkey) as t from l),
 j as (select *, t <= 400 or h <= 100 or t - h + s <= 200 as kept from w), e as (select *, not kept and coalesce(lag(kept) over (partition by l_orderkey order by h), true) as opens from j)
select cast(l_orderkey as varchar) as log_id, count(*) filter (kept or opens) as shown, count(*) filter (opens) as gaps, cast(coalesce(sum(s) filter (not kept), 0) as bigint) as elided from e group by l_orderkey"""),
    "chunked_failures": (chunked_failures, f"""with i as (select l_orderkey // 1000 as g, file || '.ts' as file, line, col, 'TS' || line as code, message, row_number() over (partition by l_orderkey // 1000 order by l_orderkey, line, file, col, message, code) as n from ({ITEMS}))
select cast(g as varchar) as log_id, 'tsc' as tool, file, cast(line as int) as line, cast(col as int) as col, code, message, cast(min(n) as int) as at from i group by g, file, line, col, code, message"""),
    "exit_status": (exit_status, f"select code, case {_STATUS} end as says from (select distinct cast(o_orderkey % 160 as int) as code from orders)"),
    "skeletons": (skeletons, f"select {_SHAPE} as signature, count(*) as n from ({ITEMS}) group by 1"),
    "repeats": (repeats, "select o_orderkey, 'a' || chr(10) || case when o_orderkey % 6 + 1 >= 3 then 'same (x' || (o_orderkey % 6 + 1) || ')' when o_orderkey % 6 = 1 then 'same' || chr(10) || 'same' else 'same' end || chr(10) || 'b' as message from orders"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _ENTRIES.items()} | {_key(r.name): _reader_query(r) for r in READERS} | document_queries.queries() | block_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql} | {_key(r.name): _reader_sql(r) for r in READERS} | document_queries.oracle_sql() | block_queries.oracle_sql()
