"""Logs under prefixes: tasks that write at once, a shared beginning, layers of both; a candidate must gain something to be kept."""

from breakweave.operators import wrappers
from breakweave.operators.readers import READERS
from breakweave.plans import report

GO = ["--- FAIL: TestA (0.00s)", "    a_test.go:7: bad a", "FAIL", "FAIL\tp\t0.1s"]
TSC = ["src/a.ts(1,2): error TS1: bad", "src/b.ts(3,4): error TS2: worse"]
RUFF = ["src/a.py:3:1: F401 unused", "src/b.py:4:1: F402 shadowed", "Found 2 errors. ruff"]


def mixed(*tasks):
    """The lines of all tasks in turn, each with its prefix."""
    longest = max(len(lines) for _, lines in tasks)
    return "\n".join(f"{prefix}{lines[i]}" for i in range(longest) for prefix, lines in tasks if i < len(lines))


LOGS = {
    "compose": mixed(("api-1  | ", GO), ("web-1  | ", TSC)),
    "brackets": mixed(("[api] ", GO), ("[lint] ", ["all", "fine", "here", "now"])),
    "literal": "\n".join("ci> " + x for x in GO),
    "layers": "\n".join("box: " + x for x in mixed(("[api] ", GO), ("[web] ", ["ok", "ok", "ok", "ok"])).split("\n")),
    "levels": "\n".join(["[info] start"] + TSC + ["[error] build failed", "[info] end", "[info] bye"]),
    "plain": "\n".join(TSC),
    "indented": "\n".join("    " + x for x in RUFF),
    "empty": "",
    "null": None,
}


def test_best_candidate_of_each_log(spark):
    logs = spark.createDataFrame([(k, v, None) for k, v in LOGS.items()], "log_id string, raw string, argv array<string>")
    got = {}
    for r in report.unwrapped(logs).where("role = 'own'").orderBy("log_id", "ord").collect():
        got.setdefault(r.log_id, []).append((r.tool, r.file, r.line, r.layers, [(p.start, p.end) for p in r.places]))
    assert got["compose"] == [("go test", "a_test.go", 7, 1, [(1, 1), (3, 3)])]
    assert got["brackets"] == [("go test", "a_test.go", 7, 1, [(1, 1), (3, 3)])]
    assert got["literal"] == [("go test", "a_test.go", 7, 1, [(1, 2)])]
    assert got["layers"] == [("go test", "a_test.go", 7, 2, [(1, 1), (3, 3)])]
    assert got["levels"] == [("tsc", "src/a.ts", 1, 0, [(2, 2)]), ("tsc", "src/b.ts", 3, 0, [(3, 3)])]
    assert got["plain"] == [("tsc", "src/a.ts", 1, 0, [(1, 1)]), ("tsc", "src/b.ts", 3, 0, [(2, 2)])]
    assert [x[:4] for x in got["indented"]] == [("ruff", "src/a.py", 3, 1), ("ruff", "src/b.py", 4, 1)]
    assert "empty" not in got and "null" not in got


def test_single_line_that_came_twice(spark):
    raw = "ci> src/a.ts(1,2): error TS1: bad\nci> src/a.ts(1,2): error TS1: bad"
    logs = spark.createDataFrame([("twice", raw, None), ("once", raw.split("\n")[0], None)], "log_id string, raw string, argv array<string>")
    rows = report.unwrapped(logs).where("role = 'own'").collect()
    assert [(r.log_id, r.tool, r.file, r.line, r.layers) for r in rows if r.tool == "tsc"] == [("twice", "tsc", "src/a.ts", 1, 1)]


def test_candidates_are_read_once(spark):
    """What was read of a log's candidates meets by log once; no log is parsed again to give lines back."""
    logs = spark.createDataFrame([(k, v, None) for k, v in LOGS.items()], "log_id string, raw string, argv array<string>")
    plan = report.unwrapped(logs, tuple(r for r in READERS if r.name in ("tsc", "go test")), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan and "Window" not in plan


def test_shared_beginning(spark):
    """The first word that all lines begin with, by characters, whatever they are; a line end of another kind stays in its line."""
    cut = lambda text: [(r.layer, r.raw) for r in wrappers.candidates(spark.createDataFrame([("a", text, None)], "log_id string, raw string, argv array<string>"), 1).orderBy("layer").collect()][1:]
    assert cut("ci> a\nci> b\n\nci> c") == [(1, "a\nb\n\nc")]
    assert cut("\U0001f600\U0001f600 a\n\U0001f600\U0001f601 b") == []
    assert cut("\U0001f600\U0001f600 a\n\U0001f600\U0001f600 b") == [(1, "a\nb")]
    assert cut("x" * 70 + " a\n" + "x" * 70 + " b") == [] and cut("a b\nc d") == [] and cut("ci> a") == []
    assert cut("   a\n     b") == [(1, "a\n  b")]
    assert cut("api | a b\nweb | c\napi | d") == [(1, "a b\nd\nc")]
