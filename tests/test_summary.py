from breakweave.operators import history, ownership
from breakweave.operators.readers import READERS
from breakweave.plans import report, summary

BY_NAME = {r.name: r for r in READERS}
PAIR = (BY_NAME["shellcheck"], BY_NAME["tsc"])


def logs(spark, *raws):
    return spark.createDataFrame([(str(i), r, None, 1, None) for i, r in enumerate(raws)], "log_id string, raw string, argv array<string>, exit_code int, signal string")


def ranked(spark, *rows):
    kinds = "log_id string, role string, reader_name string, reader int, ord int, tool string, file string, line int, col int, code string, subject string, label string, title string, message string, places array<struct<start:int,end:int>>"
    return spark.createDataFrame([("1", role, f"r{i}", i, 1, f"t{i}", file, line, col, code, None, None, title, message, [(start, start)]) for i, (role, file, line, col, code, title, message, start) in enumerate(rows)], kinds)


def test_secondaries_keep_what_is_not_said(spark):
    own = ("own", "src/a.py", 3, 2, "E1", "E1", "name 'x' is not defined", 1)
    said = [("other", "a.py", 3, None, None, "lint", "name 'x' is not defined. [E1]", 9), ("other", "b.py", 1, 1, None, "lint", "name 'x' is not defined", 1), ("other", None, None, None, "Z", "Z", "is not defined", 20)]
    new = [("other", "src/a.py", 3, 2, None, "lint", "line too long", 9), ("other", "src/a.py", 3, 2, "E2", "E2", "name 'x' is not defined", 9), ("other", "other/a.py", 3, 2, None, "lint", "name 'x' is not defined", 9), ("other", "src/a.py", None, None, None, "lint", "empty file", 9)]
    got = ownership.secondaries(ranked(spark, own, *said, *new)).collect()
    assert sorted(r.reader for r in got) == [4, 5, 6, 7]
    assert ownership.secondaries(ranked(spark, own)).count() == 0


def test_order_of_causes(spark):
    rows = [("1", "b", 2, 5, False), ("1", "c", 3, 9, True), ("1", "d", 4, 1, True), ("1", "a", 1, 1, False)]
    table = spark.createDataFrame(rows, "log_id string, id string, size int, exemplar int, reported boolean")
    assert [r.id for r in summary.ordered(table, 3).orderBy("rank").where("shown").collect()] == ["d", "c", "a"]


def test_sites_and_fences(spark):
    raw = "\n".join(f"f{i % 2}.ts({i % 2 + 1},1): error TS9: cannot assign value {i}" for i in range(6))
    row = summary.sites(report.analysed(logs(spark, raw), PAIR)).first()
    assert (row.cases, row.sites, row.headline, row.first_sites) == (6, 2, "6 cases at 2 sites", ["f0.ts:1:1", "f1.ts:2:1"])
    text = summary.markdown(report.reports(logs(spark, "a.ts(1,2): error TS1: use ```x```", "fine", None), PAIR)).orderBy("log_id").collect()
    assert "\n````text\nuse ```x```\n````" in text[0].markdown and text[1].markdown == "No failure was read (unrecognized-output)." and text[2].markdown == "No failure was read (no-output)."


def test_raw_fallback_splits_nothing(spark):
    got = summary.raw_fallback(logs(spark, "ä%" * 50, "", None, "short\n"), 100).orderBy("log_id").collect()
    assert len(got[0].annotation.encode()) <= 99 and got[0].cut and got[0].annotation.replace(" [preview truncated]", "").endswith(("ä", "%25"))
    assert [r.annotation for r in got[1:]] == ["::notice title=captured output::"] * 2 + ["::notice title=captured output::short%0A"]


def test_tallies(spark):
    raws = ["a.ts(1,2): error TS1: bad\nFound 2 errors in 1 file.", "no counts", None]
    table = logs(spark, *raws)
    got = summary.tallies(table, report.analysed(table, PAIR)).orderBy("log_id").collect()
    assert [(r.declared, r.found, r.unread) for r in got] == [(2, 1, True), (None, 0, None), (None, 0, None)]


def test_snippets(spark):
    sources = spark.createDataFrame([("a.ts", "\n".join(["def f", "  one", "", "  two", "", "end"])), ("big.ts", "x" * (2 * 1024 * 1024 + 1))], "path string, text string")
    bare = "a.ts(4,1): error TS1: bad\na.ts(9,1): error TS2: gone\nbig.ts(1,1): error TS3: large\nnone.ts(1,1): error TS4: no source\na.ts(2,1): error TS5: " + "long " * 20
    got = {r.code: r for r in summary.snippets(report.analysed(logs(spark, bare), PAIR), sources).collect()}
    assert got["TS1"].snippet == "> 4 |   two" and got["TS5"].snippet == "  1 | def f\n> 2 |   one"
    assert got["TS2"].has_line is False and got["TS2"].snippet is None and got["TS3"].has_line is None and got["TS4"].snippet is None


def test_history_round_trip(spark, tmp_path):
    table = logs(spark, "a.ts(1,2): error TS1: cannot assign value 5", "x").selectExpr("*", "if(log_id = '0', 'job', null) as run_key", "'/w' as cwd")
    found = report.analysed(table, PAIR).where("role = 'own'")
    for when in ("2024-01-01", "2024-01-02"):
        history.write(history.records(history.tracked(found, history.identity(table)), report.F.lit(when)), str(tmp_path / "runs"))
    kept = history.latest(spark.read.parquet(str(tmp_path / "runs"))).collect()
    assert len(kept) == 1 and str(kept[0].ran_at).startswith("2024-01-02") and len(kept[0].causes) == 1
