"""A log in many rows gives the failures that it gives in one."""

import random

import pytest
from pyspark.sql import functions as F
from test_blocks import GO_VERBOSE, MOCHA_NESTED, PYTEST_NATIVE, PYTEST_TWINS, TWO_DOCUMENTS

from breakweave.operators import capture, parsing, pieces
from breakweave.operators.readers import READERS
from breakweave.plans import report
from breakweave.sources.chunks import gathered, read_chunks
from breakweave.sources.logs import read_files

STAMP = "2024-05-01T10:00:00.0000000Z "
TSC = "\n".join(f"src/m{i}.ts({i},2): error TS{i}: bad" if i % 3 else "" for i in range(1, 40))
LOGS = {
    "pytest": PYTEST_TWINS, "native": PYTEST_NATIVE, "go": GO_VERBOSE, "mocha": MOCHA_NESTED, "tsc": TSC, "stamped": "\n".join(STAMP + x for x in TSC.split("\n")),
    # stamps that most of the first 400 lines lack open no gate, wherever rows are cut
    "late stamps": "\n".join(["note"] * 300 + [STAMP + x for x in TSC.split("\n")]),
    # a signal far from the lines that it lets be read
    "far signal": "src/a.c:3:4: error: no\n" + "quiet\n" * 50 + "1 error generated.",
    "ansi": "\x1b[31m" + TSC.replace("error", "\x1b[1merror\x1b[0m"), "returns": TSC.replace("\n", "\r\n"), "twice": TSC + "\n" + TSC, "empty": "", "null": None,
}
MINE = tuple(r for r in READERS if r.name in ("pytest", "go test", "mocha", "tsc", "clang", "generic"))
SHOWN = ("log_id", "role", "reader_name", "tool", "category", "file", "line", "col", "code", "subject", "label", "message", "places")


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame([(k, v, None) for k, v in LOGS.items()], "log_id string, raw string, argv array<string>")


def rows(found, *shown):
    return sorted(map(repr, found.select(*shown).collect()))


@pytest.fixture(scope="module")
def whole(logs):
    """Failures of whole logs; the exact retry is left to a test of its own."""
    return rows(report.analysed(logs.where("log_id <> 'twice'"), MINE), *SHOWN)


def test_cuts_change_nothing(logs, whole):
    once = logs.where("log_id <> 'twice'")
    cuts = pieces.cut(once, 3), pieces.cut(once, 1000)
    both = cuts[0].withColumn("log_id", F.concat(F.lit("3 "), "log_id")).unionByName(cuts[1].withColumn("log_id", F.concat(F.lit("1000 "), "log_id")))
    got = report.analysed_chunks(both, MINE).withColumn("lines", F.split("log_id", " ", 2)[0]).withColumn("log_id", F.split("log_id", " ", 2)[1]).cache()
    assert whole
    for lines in ("3", "1000"):
        assert rows(got.where(F.col("lines") == lines), *SHOWN) == whole


def test_a_retry_says_the_same_failures(logs):
    twice = logs.where("log_id = 'twice'")
    facts = [c for c in SHOWN if c != "places"]
    assert rows(report.analysed_chunks(pieces.cut(twice, 7), MINE), *facts) == rows(report.analysed(twice, MINE), *facts)


def test_documents_within_a_row(spark):
    """A document that lies within a row is read there, with its lines in the whole log."""
    n = TWO_DOCUMENTS.count("\n") + 1
    parts = [("a", 0, "quiet\n" * 9 + "quiet"), ("a", 1, TWO_DOCUMENTS), ("a", 2, "end")]
    found = report.analysed_chunks(spark.createDataFrame(parts, "log_id string, chunk int, raw string"), MINE)
    alone = report.analysed(spark.createDataFrame([("a", TWO_DOCUMENTS, None)], "log_id string, raw string, argv array<string>"), MINE)
    at = lambda f: sorted((r.file, r.line, r.message, r.places[0].start) for r in f.where("role = 'own'").collect())
    assert [(*x[:3], x[3] + 10) for x in at(alone)] == at(found) and 10 < at(found)[0][3] <= 10 + n


def test_files_in_splits(spark, tmp_path):
    """Files that Spark reads in many splits and this source in many rows; a line belongs to the split in which it begins."""
    rng = random.Random(3)
    for name in ("a.log", "b.log"):
        text = "".join(f"src/{name}{i}.ts({i},2): error TS{i}: bad \u00e9{'x' * rng.randrange(90)}\n" for i in range(1, 400))
        (tmp_path / name).write_text(text + "last line without end", encoding="utf-8")
    (tmp_path / "c.log").write_text("")
    tsc = tuple(r for r in READERS if r.name == "tsc")
    shown = ("log_id", "file", "line", "message", "places")
    want = rows(parsing.parsed(read_files(spark, str(tmp_path)), tsc), *shown)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        chunks = read_chunks(spark, str(tmp_path), 700)
        assert chunks.select("chunk.block").distinct().count() > 3 and chunks.selectExpr("max(length(raw)) as n").first().n < 1000
        assert rows(pieces.parsed(chunks, tsc), *shown) == want and len(want) == 798
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gathered_lines_keep_their_order():
    import pyarrow as pa

    lines = [("a", 0, "one"), ("a", 0, "two"), ("a", 9, ""), ("a", 9, ""), ("b", 0, "x" * 50), ("b", 0, "y")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("path", "block", "text"), x)) for x in part]) for part in (lines[:3], lines[3:])]
    got = [tuple(r.values()) for b in gathered(8)(iter(batches)) for r in b.to_pylist()]
    assert got == [("a", 0, 0, "one\ntwo"), ("a", 9, 0, "\n"), ("b", 0, 0, "x" * 50), ("b", 0, 1, "y")]
    assert list(gathered(8)(iter([]))) == []


def test_markers_for_lines_left_out(spark):
    lines = [("a", i, "error: here" if i == 50 else f"line {i:03d}") for i in range(100)] + [("b", 0, "x" * 500), ("c", 0, "short")]
    lined = spark.createDataFrame(lines, "log_id string, line_no int, text string")
    kept = {(r.log_id, r.line_no) for r in capture.captured(lined, 200, 1).collect()}
    got = sorted(capture.elided(lined, 200, 1).collect())
    assert {(r.log_id, r.line_no) for r in got if not r.elided} == kept
    marks = [(r.log_id, r.line_no, r.text) for r in got if r.elided]
    assert marks == [("a", 5, "~~~ 44 lines, 396 characters left out ~~~"), ("a", 52, "~~~ 37 lines, 333 characters left out ~~~"), ("b", 0, "~~~ 1 lines, 501 characters left out ~~~")]
