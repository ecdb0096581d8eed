"""What own failures say already: the joins of large logs against all pairs within a row, and a log of many failures on both sides."""

import random

from breakweave.operators import echoes, ownership
from breakweave.operators.readers import READERS
from breakweave.plans import report

SCHEMA = "log_id string, reader int, reader_name string, tool string, ord int, file string, line int, col int, title string, code string, subject string, label string, message string, places array<struct<start:int,end:int>>, role string"


def drawn(rng, log, role, n):
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 4))) + rng.choice(["", " failed", ": no such file", ": no such file [x1]", ". "])
    return [
        (log, int(role == "other"), f"r{role}", role, i, rng.choice([None, "a.c", "src/a.c", "lib/src/a.c", "b.c"]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, "T", "U"]), rng.choice([None, "c1", "c2"]),
         "s", None, rng.choice([None, word(), word(), word() + word()]), rng.choice([None, [], *([(a, a + rng.randrange(4))] for a in range(12)), [(1, 2), (30, 31)]]), role)
        for i in range(n)
    ]


def test_joins_give_what_all_pairs_give(spark):
    rng = random.Random(5)
    rows = [r for log in range(40) for role, n in (("own", rng.choice([0, 1, 3, 12])), ("other", rng.choice([0, 1, 20]))) for r in drawn(rng, f"l{log}", role, n)]
    ranked = spark.createDataFrame(rows, SCHEMA)
    plain, joined, mixed = (sorted(map(repr, ownership.secondaries(ranked, pairs).collect())) for pairs in (None, -1, 30))
    assert plain == joined == mixed
    others = sum(r[-1] == "other" for r in rows)
    assert 0 < len(plain) < others


def test_many_failures_on_both_sides(spark):
    """100,000 against 100,000 in one log: a third at the same place, a third echoed, a third with one message at lines of their own."""
    n = 100_000
    own = spark.range(n).selectExpr(
        "'l' as log_id", "0 as reader", "'a' as reader_name", "'a' as tool", "cast(id as int) as ord", "concat('src/f', id div 50, '.c') as file", "cast(id % 50 as int) as line", "cast(null as int) as col", "cast(null as string) as title",
        "cast(null as string) as code", "cast(null as string) as subject", "cast(null as string) as label", "if(id % 3 = 2, 'expected a value', concat('error: value ', id, ' is not known')) as message",
        "array(named_struct('start', cast(3 * id as int), 'end', cast(3 * id + 1 as int))) as places", "'own' as role",
    )
    other = own.selectExpr(
        "log_id", "1 as reader", "'b' as reader_name", "'b' as tool", "ord", "case ord % 3 when 0 then concat('/x/', file) when 1 then null else 'other.c' end as file", "if(ord % 3 = 1, null, line) as line", "col", "title",
        "code", "'s' as subject", "label", "if(ord % 3 = 1, concat('value ', ord, ' is'), message) as message", "if(ord % 3 = 2 and ord % 2 = 0, array(named_struct('start', 3 * ord + 2, 'end', 3 * ord + 2)), places) as places", "'other' as role",
    )
    got = ownership.secondaries(own.unionByName(other), ownership.PAIRS).groupBy("message").count().collect()
    # what remains has the one message between the own lines that say it; rows alike in place and message are one
    assert [(r["message"], r["count"]) for r in got] == [("expected a value", 25)]


def test_reports_of_written_failures(spark, tmp_path):
    """The report over a table of failures, all logs by joins, is the report over the logs."""
    two = tuple(r for r in READERS if r.name in ("shellcheck", "tsc"))
    raws = ("a.ts(1,2): error TS1: missing value\n\nIn b.sh line 3:\necho $x\n     ^-- SC2086 (error): Quote this.", "fine", None)
    logs = spark.createDataFrame([(str(i), r, None, 1, None) for i, r in enumerate(raws)], "log_id string, raw string, argv array<string>, exit_code int, signal string")
    report.analysed(logs, two).write.parquet(f"{tmp_path}/failures")
    found = spark.read.parquet(f"{tmp_path}/failures")
    by_joins = report.reports_of(logs, found, pairs=0).orderBy("log_id").collect()
    assert by_joins == report.reports(logs, two).orderBy("log_id").collect()
    assert by_joins[0].failures and [o.tool for o in by_joins[0].others] and by_joins[1].fallback == "unrecognized-output"


def test_long_messages_meet_by_few_marks(spark):
    texts = [f"order {n} line {n % 7} is late" for n in range(1000000, 1000400)]
    parts = spark.createDataFrame([("a", t[6:20]) for t in texts] + [("a", t[3:]) for t in texts], "log_id string, message string").distinct()
    wholes = spark.createDataFrame([("a", t) for t in texts], "log_id string, message string")
    asked = {r.message for r in parts.collect()}
    assert {(r.part, r.whole) for r in echoes.held(parts, wholes).collect()} == {(p, w) for p in asked for w in texts if p in w}
    marks = wholes.selectExpr(f"size({echoes._marks()}) as n").agg({"n": "avg"}).first()[0]
    assert marks < 6
