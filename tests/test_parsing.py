from breakweave.operators import capture, history, ownership, parsing
from breakweave.operators.readers import READERS
from breakweave.plans import report

BY_NAME = {r.name: r for r in READERS}


def logs(spark, *raws, argv=None):
    return spark.createDataFrame([(str(i), r, argv, 1, None) for i, r in enumerate(raws)], "log_id string, raw string, argv array<string>, exit_code int, signal string")


def parsed(spark, name, raw):
    r = (BY_NAME[name],)
    return parsing.parsed(logs(spark, raw), r).orderBy("ord").collect()


def test_empty_and_null_logs(spark):
    rows = report.reports(logs(spark, "", None, "all fine"), (BY_NAME["tsc"],)).orderBy("log_id").collect()
    assert [r.fallback for r in rows] == ["no-output", "no-output", "unrecognized-output"]
    assert report.reports(logs(spark, "x").limit(0), (BY_NAME["tsc"],)).count() == 0


def test_one_line_reader_deduplicates(spark):
    rows = parsed(spark, "tsc", "a.ts(1,2): error TS1: bad\nnoise\na.ts(1,2): error TS1: bad\nb.ts(3,4): error TS2: worse")
    assert [(r.file, r.line, r.col, r.code) for r in rows] == [("a.ts", 1, 2, "TS1"), ("b.ts", 3, 4, "TS2")]
    assert [(p.start, p.end) for p in rows[0].places] == [(1, 1), (3, 3)]


def test_heading_and_severity(spark):
    rows = parsed(spark, "eslint", "/w/a.js\n  1:2  error  bad thing  no-x\n  3:4  warning  meh  no-y\n\n1 problem")
    assert [(r.file, r.line, r.code) for r in rows] == [("/w/a.js", 1, "no-x")]


def test_place_after_and_before(spark):
    assert [(r.file, r.line, r.col, r.code) for r in parsed(spark, "cargo", "error[E0308]: mismatched\n  --> src/a.rs:5:9")] == [("src/a.rs", 5, 9, "E0308")]
    assert [(r.file, r.line) for r in parsed(spark, "python", 'Traceback (most recent call last):\n  File "a.py", line 1, in f\n  File "b.py", line 2, in g\nValueError: no')] == [("b.py", 2)]


def test_ci_stamp_goes(spark):
    raw = "\n".join(f"2024-01-01T00:00:0{i}.1Z {x}" for i, x in enumerate(["start", "a.ts(1,2): error TS1: bad", "end"]))
    assert [(r.file, r.code) for r in parsed(spark, "tsc", raw)] == [("a.ts", "TS1")]


def test_prefix_of_redrawn_lines_goes(spark):
    raw = "[10:00:01] 10%\r20%\r30%\n[10:00:02] a.ts(1,2): error TS1: bad\n[10:00:03] 40%\r50%\n[10:00:04] b.ts(3,4): error TS2: worse"
    assert [(r.file, r.code) for r in parsed(spark, "tsc", raw)] == [("a.ts", "TS1"), ("b.ts", "TS2")]
    assert [r.file for r in parsed(spark, "tsc", "[2024-01-02 03:04:05] a.ts(1,2): error TS1: bad")] == ["a.ts"]


def test_quoted_build_steps(spark):
    step = "------\n > [{}/4] RUN tsc:\n0.51 {}.ts(1,2): error TS1: bad\n------\n"
    end = "Dockerfile:8\nERROR: failed to solve: process \"/bin/sh -c tsc\" did not complete successfully: exit code: 2"
    pair = (BY_NAME["docker"], BY_NAME["tsc"])
    rows = report.analysed(logs(spark, step.format(1, "a") + step.format(2, "b") + end, "0.51 c.ts\n" + end), pair).where("role = 'own'").orderBy("log_id", "ord").collect()
    assert [(r.log_id, r.tool, r.file, r.places[0].start) for r in rows[:2]] == [("0", "tsc", "a.ts", 3), ("0", "tsc", "b.ts", 7)]
    assert [r.tool for r in rows[2:]] == ["docker"]


def test_winner_hint_and_secondaries(spark):
    pair = (BY_NAME["shellcheck"], BY_NAME["tsc"])
    raw = "a.sh:1:2: error: quote this [SC1]\nb.ts(3,4): error TS2: worse"
    found = report.analysed(logs(spark, raw), pair)
    assert {(r.tool, r.role) for r in found.collect()} == {("shellcheck", "own"), ("tsc", "other")}
    assert [r.tool for r in ownership.secondaries(found).collect()] == ["tsc"]
    hinted = report.analysed(logs(spark, raw, argv=["npx", "tsc"]), pair)
    assert {(r.tool, r.role) for r in hinted.collect()} == {("shellcheck", "other"), ("tsc", "own")}


def test_clusters_and_annotations(spark):
    raw = "\n".join(f"f{i}.ts({i},1): error TS9: cannot assign value {i}" for i in range(1, 5))
    rows = report.cause_report(logs(spark, raw), (BY_NAME["tsc"],)).collect()
    assert [(r.size, r.reported) for r in rows] == [(4, True)]
    notes = report.annotations(report.analysed(logs(spark, "a,b.ts(1,2): error TS1: 5% bad"), (BY_NAME["tsc"],))).collect()
    assert notes[0].annotation == "::error file=a%2Cb.ts,line=1,col=2,title=TS1::5%25 bad"


def test_capture_keeps_likely_lines(spark):
    raw = "\n".join(["x" * 20] * 50 + ["error: here"] + ["y" * 20] * 50)
    rows = capture.captured(parsing.lines(logs(spark, raw)), 400, 1).collect()
    assert sum(len(r.text) + 1 for r in rows) <= 400 and any(r.text == "error: here" and r.rescued for r in rows)
    assert not capture.captured(parsing.lines(logs(spark, "short")), 400).first().truncated


def test_history(spark):
    a = spark.createDataFrame([("i", "1"), ("i", "2")], "identity string, cause string")
    b = spark.createDataFrame([("i", "2"), ("i", "3")], "identity string, cause string")
    assert tuple(history.compared(a, b).first()) == ("i", 1, 1, 1)


def test_lines_are_read_once_and_by_asked_readers_alone(spark, capsys):
    rows = spark.createDataFrame([("a", "src/a.ts(1,2): error TS1: bad", [1]), ("b", "src/a.ts(1,2): error TS1: bad", [0])], "log_id string, raw string, asked array<int>")
    readers = tuple(r for r in READERS if r.name in ("tsc", "flake8"))
    tsc = [r.name for r in readers].index("tsc")
    found = parsing.hits(rows, readers)
    assert [(r.log_id, r.line_no, [h.reader for h in r.hits]) for r in found.collect()] == [("a" if tsc else "b", 0, [tsc])]
    found.where("size(hits) > 0").explain()
    assert len([x for x in capsys.readouterr().out.splitlines() if "RLIKE" in x]) == 1


def test_marks_hide_no_signal(spark):
    """A log that holds a signal alone is routed to its readers, whatever the signal is made of; few signals are looked for without marks."""
    signals = sorted({s for r in READERS for s in r.signals})
    logs = spark.createDataFrame([(s, f"x{s}y\n") for s in signals], "log_id string, raw string")
    got = {r.log_id: r.asked for r in parsing.routed(logs).collect()}
    assert all(got[s] == [i for i, r in enumerate(READERS) if not r.signals or any(x in f"x{s}y\n" for x in r.signals)] for s in signals)
    asked = parsing.routed(logs)._jdf.queryExecution().analyzed().toString()
    assert "marks" in asked and "marks" not in parsing.routed(logs, READERS[:3])._jdf.queryExecution().analyzed().toString()
