"""Readers of JSON and XML documents in logs: a document counts only if it has the shape that its tool writes.

Every reader is an expression over a log's text that gives an array of what it found, so all of them run in one pass, inside the row: nothing is
shuffled, and no log is read twice. JSON documents may stand between other lines, and several in one log: a fold over the lines' brackets (strings left out) finds each one that a line
opens and that closes, with its lines. Each reader parses only documents that hold its mark, with an explicit schema; what doesn't parse or lacks a
required field is null and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks, parsing

OUT = ("log_id", "tool", "file", "line", "col", "code", "subject", "message")
KINDS = {"line": "int", "col": "int"}
GOTEST = "struct<Action string, Package string, Test string, Output string>"
_AT = "startLine int, startColumn int"
#: Whole JSON documents. For each: tool, opening bracket, schema, what must hold of the document d, and the array of x over which the fields are read.
JSON = {
    "eslint_json": ("eslint", "[", "array<struct<filePath string, messages array<struct<ruleId string, severity int, line int, column int, message string>>>>", "forall(d, f -> f.filePath is not null and f.messages is not null)",
                    "flatten(transform(d, f -> transform(filter(f.messages, m -> m.severity = 2), m -> struct(f.filePath as p, m as m))))", {"file": "x.p", "line": "x.m.line", "col": "x.m.column", "code": "x.m.ruleId", "message": "x.m.message"}),
    "pyright_json": ("pyright", "{", "struct<generalDiagnostics array<struct<file string, severity string, message string, rule string, range struct<start struct<line int, character int>>>>, summary struct<errorCount int>>", "d.summary.errorCount is not null",
                     "filter(d.generalDiagnostics, m -> m.severity = 'error')", {"file": "x.file", "line": "x.range.start.line + 1", "col": "x.range.start.character + 1", "code": "x.rule", "message": "x.message"}),
    "pylint_json": ("pylint", "[", "array<struct<path string, line int, column int, `message-id` string, type string, message string>>", "forall(d, m -> m.path is not null and m.`message-id` is not null)",
                    "if(exists(d, m -> m.type in ('error', 'fatal')), filter(d, m -> m.type in ('error', 'fatal')), d)", {"file": "x.path", "line": "x.line", "col": "x.column + 1", "code": "x.`message-id`", "message": "x.message"}),
    "ruff_json": ("ruff", "[", "array<struct<filename string, location struct<row int, column int>, code string, message string>>", "forall(d, m -> m.filename is not null and m.location.row is not null)",
                  "d", {"file": "x.filename", "line": "x.location.row", "col": "x.location.column", "code": "x.code", "message": "x.message"}),
    "sarif": ("sarif", "{", f"struct<version string, runs array<struct<tool struct<driver struct<name string>>, results array<struct<ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<{_AT}>>>>>>>>>", "d.version = '2.1.0'",
              "filter(flatten(transform(d.runs, r -> r.results)), m -> coalesce(m.level, 'warning') = 'error')", {"file": "get(x.locations, 0).physicalLocation.artifactLocation.uri", "line": "get(x.locations, 0).physicalLocation.region.startLine", "col": "get(x.locations, 0).physicalLocation.region.startColumn", "code": "x.ruleId", "message": "x.message.text"}),
    "gitlab_quality": ("code quality", "[", "array<struct<check_name string, description string, fingerprint string, severity string, location struct<path string, lines struct<begin int>>>>", "forall(d, m -> m.fingerprint is not null and m.location.path is not null)",
                       "d", {"file": "x.location.path", "line": "x.location.lines.begin", "code": "x.check_name", "message": "x.description"}),
    "jest_json": ("jest", "{", "struct<numFailedTests int, testResults array<struct<name string, message string, assertionResults array<struct<status string, fullName string, title string, failureMessages array<string>, location struct<line int, column int>>>>>>", "d.numFailedTests is not null",
                  "flatten(transform(d.testResults, f -> transform(filter(f.assertionResults, m -> m.status = 'failed'), m -> struct(f.name as p, m as m))))", {"file": "x.p", "line": "x.m.location.line", "col": "x.m.location.column", "subject": "coalesce(x.m.fullName, x.m.title)", "message": "substring_index(coalesce(get(x.m.failureMessages, 0), 'test failed'), chr(10), 1)"}),
    "mocha_json": ("mocha", "{", "struct<stats struct<failures int>, failures array<struct<title string, fullTitle string, file string, err struct<message string>>>>", "d.stats.failures is not null",
                   "d.failures", {"file": "x.file", "subject": "coalesce(x.fullTitle, x.title)", "message": "x.err.message"}),
    "rubocop_json": ("rubocop", "{", "struct<metadata struct<rubocop_version string>, files array<struct<path string, offenses array<struct<severity string, message string, cop_name string, location struct<line int, column int>>>>>>", "d.metadata.rubocop_version is not null",
                     "flatten(transform(d.files, f -> transform(f.offenses, m -> struct(f.path as p, m as m))))", {"file": "x.p", "line": "x.m.location.line", "col": "x.m.location.column", "code": "x.m.cop_name", "message": "x.m.message"}),
    "stylelint_json": ("stylelint", "[", "array<struct<source string, warnings array<struct<line int, column int, rule string, severity string, text string>>>>", "forall(d, f -> f.source is not null and f.warnings is not null)",
                       "flatten(transform(d, f -> transform(filter(f.warnings, m -> m.severity = 'error'), m -> struct(f.source as p, m as m))))", {"file": "x.p", "line": "x.m.line", "col": "x.m.column", "code": "x.m.rule", "message": "x.m.text"}),
    "golangci_json": ("golangci-lint", "{", "struct<Issues array<struct<FromLinter string, Text string, Pos struct<Filename string, Line int, Column int>>>>", "d.Issues is not null",
                      "d.Issues", {"file": "x.Pos.Filename", "line": "x.Pos.Line", "col": "x.Pos.Column", "code": "x.FromLinter", "message": "x.Text"}),
    "shellcheck_json": ("shellcheck", "[", "array<struct<file string, line int, column int, level string, code int, message string>>", "forall(d, m -> m.file is not null and m.level is not null and m.code is not null)",
                        "filter(d, m -> m.level in ('error', 'warning'))", {"file": "x.file", "line": "x.line", "col": "x.column", "code": "concat('SC', x.code)", "message": "x.message"}),
    "oxlint_json": ("oxlint", "{", "struct<diagnostics array<struct<message string, code string, severity string, filename string, labels array<struct<span struct<line int, column int>>>>>>", "exists(d.diagnostics, m -> m.filename is not null)",
                    "filter(d.diagnostics, m -> m.severity = 'error')", {"file": "x.filename", "line": "get(x.labels, 0).span.line", "col": "get(x.labels, 0).span.column", "code": "x.code", "message": "x.message"}),
    "go_vet_json": ("go vet", "{", "map<string, map<string, array<struct<posn string, message string>>>>", "exists(map_values(d), a -> exists(map_values(a), m -> exists(m, y -> y.posn is not null)))",
                    "flatten(flatten(transform(map_values(d), a -> transform(map_entries(a), e -> transform(e.value, m -> struct(e.key as k, m as m))))))",
                    {"file": "regexp_extract(x.m.posn, '^(.+?):([0-9]+)', 1)", "line": "regexp_extract(x.m.posn, '^(.+?):([0-9]+)', 2)", "col": "regexp_extract(x.m.posn, '^.+?:[0-9]+:([0-9]+)', 1)", "code": "x.k", "message": "x.m.message"}),
}
#: Documents of one line each: tool, schema, what must hold of the line's document x, and the fields.
_PRIMARY = "get(filter(x.message.spans, s -> s.is_primary), 0)"
LINES = {
    "mypy_json": ("mypy", "struct<file string, line int, column int, message string, code string, severity string>", "x.file is not null and x.severity = 'error' and x.message is not null",
                  {"file": "x.file", "line": "x.line", "col": "x.column", "code": "x.code", "message": "x.message"}),
    "cargo_json": ("cargo", "struct<reason string, message struct<message string, level string, code struct<code string>, spans array<struct<file_name string, line_start int, column_start int, is_primary boolean>>>>", "x.reason = 'compiler-message' and x.message.level = 'error'",
                   {"file": f"{_PRIMARY}.file_name", "line": f"{_PRIMARY}.line_start", "col": f"{_PRIMARY}.column_start", "code": "x.message.code.code", "message": "x.message.message"}),
}
#: What a document must hold to be parsed for a reader.
MARKS = {
    "eslint_json": "filePath", "pyright_json": "generalDiagnostics", "pylint_json": "message-id", "ruff_json": "filename", "sarif": "runs", "gitlab_quality": "fingerprint", "jest_json": "testResults", "mocha_json": "stats",
    "rubocop_json": "rubocop_version", "stylelint_json": "warnings", "golangci_json": "Issues", "shellcheck_json": "level", "oxlint_json": "diagnostics", "go_vet_json": "posn", "mypy_json": "severity", "cargo_json": "reason",
}
TESTS = ("jest_json", "mocha_json", "junit_xml", "teamcity", "trx")


#: A line that opens a document: a bracket, and then nothing, a string or another bracket.
_LEAD = r"^[ \t]*[\[{][ \t]*(?:$|[\"\[{\]}])"
_SPAN = "array<struct<start:int,end:int>>"


def spans(raw: Column) -> Column:
    """(start, end) of the lines of every JSON document of several lines: from one that opens it to the one where all brackets are closed; a bracket at the margin that stays open starts anew."""
    lines = F.split(raw, "\n", -1)
    # escapes, then strings (which end on their line), then all but brackets
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\[^\n]", ""), '"[^"\n]*"', ""), r"[^\[\]{}\n]", "")
    line = lambda x, i: F.struct(i.alias("n"), (2 * F.length(F.regexp_replace(x, r"[\]}]", "")) - F.length(x)).alias("net"), F.get(lines, i).rlike(_LEAD).alias("lead"), F.get(lines, i).rlike(r"^[\[{]").alias("margin"))
    steps = F.filter(F.transform(F.split(bare, "\n", -1), line), lambda x: x["net"] != 0)
    state = lambda depth, start, margin, out: F.struct(depth.cast("int").alias("depth"), start.cast("int").alias("start"), margin.alias("margin"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["lead"] & (x["net"] > 0) & ((acc["depth"] == 0) | (acc["margin"] & x["margin"]))
        depth = acc["depth"] + x["net"]
        ended = F.array_append(acc["out"], F.struct(acc["start"].alias("start"), x["n"].cast("int").alias("end")))
        idle = state(F.lit(0), F.lit(-1), F.lit(False), acc["out"])
        return F.when(opens, state(x["net"], x["n"], x["margin"], acc["out"])).when(acc["depth"] == 0, idle).when(depth <= 0, state(F.lit(0), F.lit(-1), F.lit(False), ended)).otherwise(state(depth, acc["start"], acc["margin"], acc["out"]))

    return F.aggregate(steps, state(F.lit(0), F.lit(-1), F.lit(False), F.array().cast(_SPAN)), step, lambda acc: acc["out"])


def prepared(logs: DataFrame) -> DataFrame:
    """Adds json: (start, end, text) of the documents that a log holds, those of several lines and those of one, and json_lines: (start, text) of lines that open an object; null where no line opens a document."""
    raw = F.col("raw")
    logs = logs.withColumn("split", F.when(raw.rlike("(?m)" + _LEAD), F.split(raw, "\n", -1)))
    logs = logs.withColumn("spans", F.when(F.col("split").isNotNull(), spans(raw)))
    whole = F.transform("spans", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.array_join(F.slice("split", d["start"] + 1, d["end"] - d["start"] + 1), "\n").alias("text")))
    numbered = F.transform("split", lambda x, i: F.struct(i.cast("int").alias("start"), i.cast("int").alias("end"), x.alias("text")))
    single = F.filter(numbered, lambda x: x["text"].rlike(_LEAD) & x["text"].rlike(r"[\]}]\s*$") & ~F.exists("spans", lambda d: (d["start"] <= x["start"]) & (x["start"] <= d["end"])))
    objects = F.filter(numbered, lambda x: x["text"].startswith("{"))
    return logs.withColumn("json", F.concat(whole, single)).withColumn("json_lines", objects).drop("split", "spans")


def _struct(tool: str, fields: dict[str, str], at: str) -> str:
    shown = ", ".join(f"'{c}', try_cast({fields.get(c, 'null')} as {KINDS.get(c, 'string')})" for c in OUT[2:])
    return f"named_struct('tool', '{tool}', {shown}, 'start', {at}.start, 'end', {at}.end)"


def _json(name: str) -> Column:
    tool, opens, schema, holds, over, fields = JSON[name]
    mine = f"filter(json, j -> startswith(ltrim(j.text), '{opens}') and contains(j.text, '\"{MARKS[name]}\"'))"
    # a one-element array binds the document to d, so that it is parsed once
    return F.expr(f"flatten(transform({mine}, j -> coalesce(get(transform(array(from_json(j.text, '{schema}')), d -> if(d is not null and {holds}, transform({over}, x -> {_struct(tool, fields, 'j')}), null)), 0), array())))")


def _json_lines(name: str) -> Column:
    tool, schema, holds, fields = LINES[name]
    mine = f"filter(json_lines, l -> contains(l.text, '\"{MARKS[name]}\"'))"
    read = f"transform(array(from_json(l.text, '{schema}')), x -> if(x is not null and {holds}, {_struct(tool, fields, 'l')}, null))"
    return F.expr(f"array_compact(flatten(transform({mine}, l -> {read})))")


def _row(tool: str, at: tuple[Column, Column] | None = None, **columns: Column) -> Column:
    start, end = at or (F.lit(0), F.lit(0))
    return F.struct(F.lit(tool).alias("tool"), *(columns.get(c, F.lit(None)).try_cast(KINDS.get(c, "string")).alias(c) for c in OUT[2:]), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _elements(mark: str, pattern: str) -> Column:
    return F.when(F.contains(F.col("raw"), F.lit(mark)), F.regexp_extract_all("raw", F.lit(pattern), F.lit(0)))


def _region(mark: str) -> tuple[Column, Column]:
    """The lines from the first mark on to the last closing tag."""
    lines = lambda x: F.size(F.split(x, "\n", -1))
    return lines(F.substring_index("raw", mark, 1)) - 1, lines(F.col("raw")) - lines(F.substring_index("raw", "</", -1))


def _marked_lines(mark: str, pattern: str) -> Column:
    """(n, text) of the lines that a pattern finds."""
    numbered = F.transform(F.split("raw", "\n", -1), lambda x, i: F.struct(i.alias("n"), x.alias("text")))
    return F.when(F.contains(F.col("raw"), F.lit(mark)), F.filter(numbered, lambda x: x["text"].rlike(pattern)))


def _xml_text(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#xA;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _attribute(element: Column, name: str) -> Column:
    got = [F.nullif(F.regexp_extract(element, rf"\s{name}={q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")]
    return _xml_text(F.coalesce(*got))


def _body(element: Column, tag: str) -> Column:
    """The first line of text of the element's first child of that name, CDATA or not."""
    text = F.regexp_extract(element, rf"(?s)<(?:{tag})\b[^>]*>\s*(?:<!\[CDATA\[\s*)?([^<\]\n]+)", 1)
    return F.nullif(_xml_text(F.trim(text)), F.lit(""))


def junit_xml() -> Column:
    """Test cases with a failure or an error."""
    cases = F.filter(_elements("<testsuite", r"(?s)<testcase\b(?:[^>]*[^/])?>.*?</testcase>"), lambda e: e.rlike(r"<(?:failure|error)[ />]"))

    def read(e: Column) -> Column:
        head, fail = F.regexp_extract(e, "(?s)^<testcase[^>]*>", 0), F.regexp_extract(e, "(?s)<(?:failure|error)[^>]*>", 0)
        return _row("junit", _region("<testsuite"), file=_attribute(head, "file"), line=_attribute(head, "line"), subject=_attribute(head, "name"), message=F.coalesce(_attribute(fail, "message"), _body(e, "failure|error")))

    return F.transform(cases, read)


def checkstyle_xml() -> Column:
    def read(f: Column) -> Column:
        errors = F.filter(F.regexp_extract_all(f, F.lit(r"<error\b[^>]*/>"), F.lit(0)), lambda e: _attribute(e, "severity") == "error")
        return F.transform(errors, lambda e: _row("checkstyle", _region("<checkstyle"), file=_attribute(f, "name"), line=_attribute(e, "line"), col=_attribute(e, "column"), code=_attribute(e, "source"), message=_attribute(e, "message")))

    return F.flatten(F.transform(_elements("<checkstyle", r"(?s)<file\b[^>]*>.*?</file>"), read))


def trx() -> Column:
    """Failed results of test runs, with the place that the stack trace names first."""
    failed = F.filter(_elements("<UnitTestResult", r"(?s)<UnitTestResult\b[^>]*[^/]>.*?</UnitTestResult>"), lambda e: F.regexp_extract(e, "(?s)^<[^>]*>", 0).contains('outcome="Failed"'))
    place = lambda e, i: F.nullif(F.regexp_extract(e, r" in (\S.*?):line (\d+)", i), F.lit(""))
    return F.transform(failed, lambda e: _row("dotnet test", _region("<UnitTestResult"), file=place(e, 1), line=place(e, 2), subject=_attribute(F.regexp_extract(e, "(?s)^<[^>]*>", 0), "testName"), message=_body(e, "Message")))


def github_annotations() -> Column:
    """::error lines of workflow logs; percent codes are decoded."""

    def decoded(text: Column) -> Column:
        for code, plain in (("%0D", "\r"), ("%0A", "\n"), ("%3A", ":"), ("%2C", ","), ("%25", "%")):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def read(line: Column) -> Column:
        text = line["text"]
        props = F.str_to_map(F.regexp_extract(text, r"^::error ?(.*?)::", 1), F.lit(","), F.lit("="))
        return _row("github", (line["n"], line["n"]), file=decoded(props["file"]), line=props["line"], col=props["col"], code=decoded(props["title"]), message=decoded(F.regexp_extract(text, r"^::error.*?::(.*)$", 1)))

    return F.transform(_marked_lines("::error", "^::error[ :]"), read)


def teamcity() -> Column:
    """Failed tests of service messages; bar escapes are decoded in one pass (a doubled bar is set aside first)."""

    def value(text: Column, name: str) -> Column:
        text = F.replace(F.regexp_extract(text, rf" {name}='((?:[^'|]|\|.)*)'", 1), F.lit("||"), F.lit("\u0001"))
        for code, plain in (("|n", "\n"), ("|r", "\r"), ("|'", "'"), ("|[", "["), ("|]", "]"), ("\u0001", "|")):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return F.nullif(text, F.lit(""))

    # the details' first line that is a place alone
    place = lambda x, i: F.nullif(F.regexp_extract(value(x, "details"), r"(?m)^\s*(\S+):(\d+)\s*$", i), F.lit(""))
    read = lambda e, x: _row("teamcity", (e["n"], e["n"]), file=place(x, 1), line=place(x, 2), subject=value(x, "name"), message=value(x, "message"))
    return F.transform(_marked_lines("##teamcity[testFailed ", r"^##teamcity\[testFailed "), lambda e: read(e, e["text"]))


def azure_logissue() -> Column:
    """Error issues of pipeline logging commands; percent codes are decoded."""

    def decoded(text: Column) -> Column:
        for code, plain in (("%3B", ";"), ("%0D", "\r"), ("%0A", "\n"), ("%5D", "]"), ("%AZP25", "%")):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def read(line: Column) -> Column:
        text = line["text"]
        props = F.str_to_map(F.regexp_extract(text, r"^##vso\[task\.logissue ([^\]]*)\]", 1), F.lit(";"), F.lit("="))
        return _row("azure", (line["n"], line["n"]), file=decoded(props["sourcepath"]), line=props["linenumber"], col=props["columnnumber"], code=decoded(props["code"]), message=decoded(F.regexp_extract(text, r"^[^\]]*\](.*)$", 1)))

    return F.transform(_marked_lines("##vso[task.logissue ", r"^##vso\[task\.logissue [^\]]*type=error[^\]]*\]"), read)


def _expressions() -> dict[str, Column]:
    out = {n: _json(n) for n in JSON} | {n: _json_lines(n) for n in LINES}
    return out | {f.__name__: f() for f in (junit_xml, checkstyle_xml, trx, teamcity, github_annotations, azure_logissue)}


def _reader(name: str):
    return lambda logs: prepared(logs).select("log_id", F.inline(_expressions()[name])).select(*OUT)


def _each_line(logs: DataFrame, schema: str) -> DataFrame:
    return parsing.lines(logs).where(F.col("text").startswith("{")).select("log_id", "line_no", F.from_json("text", schema).alias("d"))


def go_test_json(logs: DataFrame) -> DataFrame:
    """Failed tests, with the place of the last output line that names one before the failure."""
    rows = _each_line(logs, GOTEST).where("d.Test is not null")
    place = F.struct(F.regexp_extract("d.Output", r"^\s+([^\s:]+_test\.go):(\d+): ", 1).alias("file"), F.regexp_extract("d.Output", r"^\s+([^\s:]+_test\.go):(\d+): ", 2).alias("line"), F.regexp_extract("d.Output", r"^\s+[^\s:]+_test\.go:\d+: (.*)", 1).alias("message"))
    got = rows.groupBy("log_id", "d.Package", "d.Test").agg(F.max(F.when(F.col("d.Action") == "fail", 1)).alias("failed"), F.max_by(F.when(F.col("d.Output").rlike(r"^\s+[^\s:]+_test\.go:\d+: "), place), F.when(F.col("d.Output").rlike(r"^\s+[^\s:]+_test\.go:\d+: "), F.col("line_no"))).alias("p"))
    row = _row("go test", file=F.col("p.file"), line=F.col("p.line"), subject=F.col("Test"), message=F.col("p.message"))
    return got.where("failed = 1").select("log_id", row.alias("r")).select("log_id", "r.*")


NAMES = (*JSON, *LINES, "junit_xml", "checkstyle_xml", "trx", "teamcity", "github_annotations", "azure_logissue")
DOCUMENTS = {n: _reader(n) for n in NAMES} | {"go_test_json": go_test_json}


def _tool(name: str) -> str:
    own = {"junit_xml": "junit", "checkstyle_xml": "checkstyle", "trx": "dotnet test", "teamcity": "teamcity", "github_annotations": "github", "azure_logissue": "azure"}
    return own[name] if name in own else (JSON.get(name) or LINES[name])[0]


#: (name, tool, category) of the documents, which come before lines, in this order.
SOURCES = tuple((n, _tool(n), "test" if n in TESTS else "lint") for n in NAMES)


def found(logs: DataFrame) -> DataFrame:
    """Adds docs: what all documents of a log say, as hits with the lines of their document; readers count from -len(NAMES) on."""

    cells = {c: f"nullif(cast(x.{c} as string), '')" for c in OUT[2:]}
    row = lambda i: blocks.struct(i - len(NAMES), "document", cells, end="x.end", n="k", line="x.start")
    every = ", ".join(f"coalesce(transform(doc{i}, (x, k) -> {row(i)}), array())" for i in range(len(NAMES)))
    rows = prepared(logs).withColumns({f"doc{i}": each for i, each in enumerate(_expressions().values())})
    return rows.withColumn("docs", F.expr(f"concat({every})")).drop("json", "json_lines", *(f"doc{i}" for i in range(len(NAMES))))
