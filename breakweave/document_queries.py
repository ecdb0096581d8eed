"""Queries of the document readers over logs rendered as the tools' documents, and what they must give back in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.documents import DOCUMENTS, OUT
from .sources.logs import ITEMS, items

#: For each document: the SQL of one element from the facts, what joins elements and encloses them, and the fields that come back (others are null).
_J = "to_json(named_struct({}))"
SHAPES = {
    "eslint_json": (_J.format("'filePath', file, 'messages', array(named_struct('ruleId', code, 'severity', 2, 'line', int(line), 'column', int(col), 'message', message))"), ",", "[", "]", "eslint", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "pyright_json": (_J.format("'file', file, 'severity', 'error', 'message', message, 'rule', code, 'range', named_struct('start', named_struct('line', int(line) - 1, 'character', int(col) - 1))"), ",", '{"generalDiagnostics":[', '],"summary":{"errorCount":1}}', "pyright", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "pylint_json": (_J.format("'path', file, 'line', int(line), 'column', int(col) - 1, 'message-id', 'E000' || line, 'type', 'error', 'message', message"), ",", "[", "]", "pylint", {"file": "file", "line": "line", "col": "col", "code": "'E000' || line", "message": "message"}),
    "ruff_json": (_J.format("'filename', file, 'location', named_struct('row', int(line), 'column', int(col)), 'code', code, 'message', message"), ",", "[", "]", "ruff", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "sarif": (_J.format("'ruleId', code, 'level', 'error', 'message', named_struct('text', message), 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', file), 'region', named_struct('startLine', int(line), 'startColumn', int(col)))))"), ",", '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"t"}},"results":[', "]}]}", "sarif", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "gitlab_quality": (_J.format("'check_name', code, 'description', message, 'fingerprint', md5(message), 'severity', 'major', 'location', named_struct('path', file, 'lines', named_struct('begin', int(line)))"), ",", "[", "]", "code quality", {"file": "file", "line": "line", "code": "code", "message": "message"}),
    "mypy_json": (_J.format("'file', file, 'line', int(line), 'column', int(col), 'message', message, 'code', code, 'severity', 'error'"), "\n", "", "\nFound", "mypy", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "cargo_json": (_J.format("'reason', 'compiler-message', 'message', named_struct('message', message, 'level', 'error', 'code', named_struct('code', code), 'spans', array(named_struct('file_name', file, 'line_start', int(line), 'column_start', int(col), 'is_primary', true)))"), "\n", "", "\n{}", "cargo", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "jest_json": (_J.format("'name', file, 'assertionResults', array(named_struct('status', 'failed', 'fullName', subject, 'failureMessages', array(concat(message, chr(10), 'at')), 'location', named_struct('line', int(line), 'column', int(col))), named_struct('status', 'passed', 'fullName', 'other', 'failureMessages', array(''), 'location', named_struct('line', 1, 'column', 1)))"), ",", 'npm test\n{"numFailedTests":1,"testResults":[', "]}", "jest", {"file": "file", "line": "line", "col": "col", "subject": "subject", "message": "message"}),
    "mocha_json": (_J.format("'fullTitle', subject, 'file', file, 'err', named_struct('message', message)"), ",", '{"stats":{"failures":1},"failures":[', "]}\ndone", "mocha", {"file": "file", "subject": "subject", "message": "message"}),
    "rubocop_json": (_J.format("'path', file, 'offenses', array(named_struct('severity', 'convention', 'message', message, 'cop_name', code, 'location', named_struct('line', int(line), 'column', int(col))))"), ",", '{"metadata":{"rubocop_version":"1.50"},"files":[', "]}", "rubocop", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "stylelint_json": (_J.format("'source', file, 'warnings', array(named_struct('line', int(line), 'column', int(col), 'rule', code, 'severity', 'error', 'text', message))"), ",", "[", "]", "stylelint", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "golangci_json": (_J.format("'FromLinter', code, 'Text', message, 'Pos', named_struct('Filename', file, 'Line', int(line), 'Column', int(col))"), ",", '{"Issues":[', "]}", "golangci-lint", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "shellcheck_json": (_J.format("'file', file, 'line', int(line), 'column', int(col), 'level', 'error', 'code', int(line), 'message', message"), ",", "[", "]", "shellcheck", {"file": "file", "line": "line", "col": "col", "code": "'SC' || line", "message": "message"}),
    "oxlint_json": (_J.format("'message', message, 'code', code, 'severity', 'error', 'filename', file, 'labels', array(named_struct('span', named_struct('line', int(line), 'column', int(col))))"), ",", '{"diagnostics":[', "]}", "oxlint", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "go_vet_json": ("concat('\"p', file, line, col, message, '\":', " + _J.format("'printf', array(named_struct('posn', concat(file, ':', line, ':', col), 'message', message))") + ")", ",", "# vet\n{", "}", "go vet", {"file": "file", "line": "line", "col": "col", "code": "'printf'", "message": "message"}),
    "trx": ("concat('<UnitTestResult testName=\"', subject, '\" outcome=\"Failed\"><Message>', message, '</Message><StackTrace>at A.B() in ', file, '.cs:line ', line, '</StackTrace></UnitTestResult>')", "\n", "<TestRun>", "</TestRun>", "dotnet test", {"file": "file || '.cs'", "line": "line", "subject": "subject", "message": "message"}),
    "junit_xml": ("'<testcase name=\"' || subject || '\" file=\"' || file || '\" line=\"' || line || '\"><failure message=\"' || message || '\"/></testcase>'", "\n", "<testsuite>", "</testsuite>", "junit", {"file": "file", "line": "line", "subject": "subject", "message": "message"}),
    "checkstyle_xml": ("'<file name=\"' || file || '\"><error line=\"' || line || '\" column=\"' || col || '\" severity=\"error\" message=\"' || message || '\" source=\"' || code || '\"/></file>'", "\n", "<checkstyle>", "</checkstyle>", "checkstyle", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message"}),
    "github_annotations": ("'::error file=' || file || ',line=' || line || ',col=' || col || ',title=' || code || '::' || message || '%25'", "\n", "", "\n", "github", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message || '%'"}),
    "azure_logissue": ("concat('##vso[task.logissue type=error;sourcepath=', file, ';linenumber=', line, ';columnnumber=', col, ';code=', code, ';]', message, '%3B')", "\n", "##vso[task.logissue type=warning;]no\n", "\n", "azure", {"file": "file", "line": "line", "col": "col", "code": "code", "message": "message || ';'"}),
    "teamcity": ("concat(\"##teamcity[testFailed name='\", subject, \"' message='\", message, \"|n']\")", "\n", "", "\n", "teamcity", {"subject": "subject", "message": "message || chr(10)"}),
}


def _query(name: str):
    element, between, before, after, _, _ = SHAPES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = items(spark, sf_dir).select("l_orderkey", F.expr(element).alias("e")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("es"))
        logs = parts.select(F.col("l_orderkey").cast("string").alias("log_id"), F.concat(F.lit(before), F.array_join("es", between), F.lit(after)).alias("raw"))
        return DOCUMENTS[name](logs)

    return query


def _sql(name: str) -> str:
    *_, tool, fields = SHAPES[name]
    kinds = {"line": "int", "col": "int"}
    cells = [f"cast({fields.get(c, 'null')} as {kinds.get(c, 'varchar')}) as {c}" for c in OUT[2:]]
    return f"select cast(l_orderkey as varchar) as log_id, '{tool}' as tool, {', '.join(cells)} from ({ITEMS})"


def queries() -> dict:
    return {f"document_{n}": _query(n) for n in SHAPES}


def oracle_sql() -> dict[str, str]:
    return {f"document_{n}": _sql(n) for n in SHAPES}
