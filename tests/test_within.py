"""Failures found within a log's row: the same as by shuffled hits, and without a shuffle."""

from breakweave import registry
from breakweave.functions import text as T
from breakweave.operators import parsing, within
from breakweave.operators.readers import READERS
from breakweave.plans import report

BY_NAME = {r.name: r for r in READERS}
MINE = tuple(BY_NAME[n] for n in ("pytest", "jest", "mocha", "eslint", "shellcheck", "cargo", "gofmt", "go test json", "go test", "tsc"))
SHOWN = ("log_id", "reader_name", "ord", "file", "line", "col", "title", "code", "subject", "label", "message", "line_no", "places")
LOGS = (
    "", "\n", "nothing here",
    "a.ts(1,2): error TS1: x\na.ts(1,2): error TS1: x\n\na.ts(1,2): error TS1: x\nb.ts(0,2): error TS2: y",
    "/w/a.js\n  1:2  error  no  rule-a\n  2:1  warning  w  rule-b\n/w/b.js\n  3:4  error  no  rule-a\n2 problems",
    "error[E0001]: one\n  --> a.rs:1:2\nerror[E0002]: two\nerror: could not compile `a`\n\n\n\n\n  --> b.rs:3:4",
    "In a.sh line 3:\necho $x\n     ^-- SC2086 (error): Double quote.\na.sh:1:2: error: m [SC1]",
    "___ test_a ___\nE   assert 1\nx.py:3: AssertionError\n___ test_a ___\nE   KeyError\nlib.py:5: in f\nx.py:9: KeyError\n=== short test summary info ===\nFAILED x.py::test_a - assert 1\nFAILED x.py::test_a - KeyError\nFAILED y.py::test_b - z",
    "FAIL src/a.test.js\n  ● adds › one\n    expected 1\n      at f (src/a.js:1:2)\n      at g (src/a.test.js:3:4)\nFAIL src/b.test.js\n  ● subs\n    no\nTest Suites: 2 failed\n  ● late",
    "  1) before\n  2 failing\n  1) adds\n       numbers:\n     wrong\n      at f (a.js:1:2)\n  2) subs\n     bad\n",
    "diff a.go.orig a.go\n--- a.go.orig\n+++ a.go\n@@ -1,3 +1,3 @@\n x\n-y\n+z\n@@ -9,2 +9,3 @@\n a\n+b\n@@ -2,1 +2,1 @@\n-q\ndiff b.go.orig b.go\n--- other\n@@ -1 +1 @@\n-a",
    '{"Action":"output","Package":"p","Test":"A","Output":"    a_test.go:3: bad\\n"}\n{"Action":"output","Package":"p","Test":"B","Output":"    b_test.go:4: worse\\n"}\n{"Action":"fail","Package":"p","Test":"B"}\n{"Action":"fail","Package":"p","Test":"A"}\n{"Action":"fail","Package":"p","Test":"C"}',
    "=== RUN   A\n=== RUN   B\n    b_test.go:4: worse\n=== CONT  A\n    a_test.go:3: bad\n--- FAIL: A (0.00s)\n--- FAIL: B (0.00s)\nFAIL\n--- FAIL: A (0.00s)\n    a_test.go:7: again\nok  \tp\t0.1s",
)


def test_same_as_by_hits(spark):
    logs = spark.createDataFrame([(str(i), raw) for i, raw in enumerate(LOGS)], "log_id string, raw string")
    ready = parsing.narrowed(parsing.unwrapped(parsing.gated(parsing.routed(parsing.normalised(logs), MINE))), MINE)
    want, got = parsing.read(ready, MINE), parsing.parsed(logs, MINE)
    assert got.columns == want.columns
    cells = lambda rows: sorted(map(repr, rows.select(*SHOWN).collect()))
    found = cells(got)
    assert found == cells(want) and len(found) > 20


def test_nothing_is_shuffled(spark):
    logs = spark.createDataFrame([("1", LOGS[3])], "log_id string, raw string")
    plan = parsing.parsed(logs, (BY_NAME["tsc"], BY_NAME["mocha"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan.replace("sort_array", "")


def test_named_values_are_not_copied(spark):
    """An element of a transformed array is copied whole at every level; the last step of a fold is not."""
    assert ")[0]" not in within.failures(MINE)
    rows = spark.createDataFrame([("a\na\na\nb\nb\n \n \n ",), ("x",), ("",)], "t string")
    got = rows.selectExpr(f"{T.collapsed('t')} as got", "t")
    assert [r.got for r in got.collect()] == ["a (x3)\nb\nb\n \n \n ", "x", ""]
    assert got.where(got.got != T.collapse_repeats(got.t)).count() == 0


def test_what_others_add_is_found_in_the_row(spark, tmp_path):
    """Shuffles: the lines of a log, to make it; then only counts of tools."""
    fields = "cast(1 as bigint) as l_orderkey, cast(2 as bigint) as l_partkey, cast(3 as bigint) as l_suppkey, cast(1 as int) as l_linenumber, cast(5 as double) as l_quantity"
    spark.sql(f"select {fields}").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = registry.secondaries(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("pyright", 1), ("tsc", 1)]


def test_one_search_gives_all_groups(spark):
    """The groups are those of the first match, as regexp_extract has them, and a line is searched once."""
    cases = [
        (r"^([^\s:]+):(\d+)(?::(\d+))?$", "a:1", "a:1:2", "b a:1", "a:1 ", "", "a:1\u0001"), (r"(\w+)=(\d*)", "x=1, yy=22", "none", "=", "$1=2 \\=3"),
        (r"^a(b)?|(c)d", "ab", "xcd", "a", "cdcd", "zz"), (r"^(?:x|y)(\|)?", "x|", "y", "z"), (r"(?i)^((?:.*\b)?error\b.*)$", "An ERROR here", "no"),
    ]
    for pattern, *lines in cases:
        n = pattern.replace("(?", "").replace(r"\(", "").count("(")
        rows = spark.createDataFrame([(x,) for x in lines], "t string")
        want = f"if(t rlike {T.quoted(pattern)}, array({', '.join(f'regexp_extract(t, {T.quoted(pattern)}, {i + 1})' for i in range(n))}), null)"
        for r in rows.selectExpr("t", f"{T.matched('t', pattern, n, f'slice(m, 2, {n})')} as got", f"{want} as want").collect():
            assert r.got == r.want or n == 0 and (r.got is None) == (r.want is None), (pattern, r)
    tsc = within.failures((BY_NAME["tsc"],))
    assert tsc.count("regexp_replace(text") == 1 and "regexp_extract" not in tsc and "rlike" not in tsc


def test_owner_alone_is_what_the_analysis_gives(spark):
    """The failures of a log's owner, found without asking those after it: hints, guesses, a build's own last line and documents as in the whole analysis."""
    mine = tuple(BY_NAME[n] for n in ("pytest", "shellcheck", "docker", "tsc", "generic"))
    build = 'ERROR: failed to solve: process "/bin/sh" did not complete\n'
    document = '[{"filePath":"a.js","messages":[{"ruleId":"r","severity":%d,"line":1,"column":2,"message":"m"}]}]\n'
    raws = (*LOGS, build, build + "a.ts(1,2): error TS1: x", build + "some error", "some error\nERROR: failed to push", document % 2 + LOGS[3], document % 1 + LOGS[3], LOGS[7] + "\n" + LOGS[3] + "\n" + LOGS[6])
    rows = [(f"{i} {argv}", raw, argv and argv.split()) for i, raw in enumerate(raws) for argv in (None, "npx tsc", "docker build", "shellcheck a.sh")]
    logs = spark.createDataFrame(rows, "log_id string, raw string, argv array<string>")
    # a guess comes last wherever it stands
    for readers in (mine, mine[::-1]):
        want, got = report.analysed(logs, readers).where("role = 'own'"), report.owned(logs, readers)
        assert got.columns == want.columns
        cells = sorted(map(repr, got.collect()))
        assert cells == sorted(map(repr, want.collect())) and len(cells) > 40
    assert {r.tool for r in report.owned(logs, mine).select("tool").distinct().collect()} == {"pytest", "shellcheck", "docker", "tsc", "generic", "eslint"}


def test_text_without_a_diagnostic_is_searched_once(spark):
    """Each reader's gate over a whole text lets all of its samples pass, wherever they stand."""
    facts = dict(file="src/a", line="3", col="4", code="K1", message="value 3 too large", subject="case_1")
    for r in READERS:
        text = "before\n" + "\n".join(r.sample if r.name == "go test json" else [x.format_map(facts) for x in r.sample]) + "\nafter\n"
        assert spark.createDataFrame([(text,)], "raw string").selectExpr(f"({within.gate(r)}) as g").first().g, r.name
    assert not spark.createDataFrame([("a: 1\n",)], "raw string").selectExpr(f"({within.gate(BY_NAME['flake8'])}) as g").first().g
