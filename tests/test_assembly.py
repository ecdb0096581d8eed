"""Logs whose chunks arrive mixed, late, twice or not at all."""

import datetime

import pytest

from breakweave.streaming import assembly
from breakweave.streaming.logs import analyse

SCHEMA = "log_id string, chunk int, raw string, last boolean, ts timestamp"


def _at(second: int):
    return datetime.datetime(2024, 5, 1, 10, 0, 0) + datetime.timedelta(seconds=second)


@pytest.fixture
def stateful(spark):
    """The session with the state store that assembly needs, and few partitions of state."""
    store, partitions = assembly.STORE[0], "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (store, partitions)}
    spark.conf.set(*assembly.STORE)
    spark.conf.set(partitions, "2")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_chunks_of_two_logs_mixed_and_late(stateful, tmp_path):
    batches = [
        # the end of one log before its beginning, the beginning of another, and a third that never ends
        [("a", 2, "TS2: two\n", True, _at(0)), ("b", 0, "src/b.ts(1,2): error TS1: on", False, _at(1)), ("c", 1, "src/c.ts(7,1): error TS7: seven\n", False, _at(1)), (None, 0, "lost", True, _at(1)), ("d", None, "lost", True, _at(1))],
        [("a", 0, "src/a.ts(3,4): error TS3: three\n", None, _at(5)), ("a", 0, "again", False, _at(5)), ("e", 0, None, True, _at(5))],
        [("b", 1, "e\n", True, _at(6)), ("a", 1, "src/a.ts(5,6): error ", False, _at(2))],
        # time goes on, so that c closes; its first chunk comes after that, and is a log of its own
        [("f", 0, "quiet", True, _at(2000))],
        [("c", 0, "src/c.ts(6,1): error TS6: six\n", True, _at(2001))],
    ]
    folder, out = tmp_path / "in", []
    folder.mkdir()
    for i, rows in enumerate(batches):
        stateful.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = stateful.readStream.schema(SCHEMA).parquet(str(folder))
        sink = lambda df, n: out.extend(df.collect())
        logs = assembly.assembled(stream, wait_seconds=60, late="30 seconds")
        query = logs.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination(120)
        got = sorted((r.log_id, r.complete, r.chunks, r.missing) for r in out)
        # each run starts again from the checkpoint, as after a lost executor or driver
        if i == 1:
            assert got == [("e", True, 1, 0)]
        if i == 2:
            assert got == [("a", True, 3, 0), ("b", True, 2, 0), ("e", True, 1, 0)]
    assert got == [("a", True, 3, 0), ("b", True, 2, 0), ("c", False, 1, 1), ("c", True, 1, 0), ("e", True, 1, 0), ("f", True, 1, 0)]
    texts = {(r.log_id, r.complete): r.raw for r in out}
    assert texts["a", True] == "src/a.ts(3,4): error TS3: three\nsrc/a.ts(5,6): error TS2: two\n"
    assert texts["b", True] == "src/b.ts(1,2): error TS1: one\n" and texts["e", True] == ""
    assert texts["c", False] == "src/c.ts(7,1): error TS7: seven\n"


def test_assembled_logs_are_analysed(stateful, tmp_path):
    rows = [("a", 1, "or TS3: three\n", True, _at(0)), ("a", 0, "src/a.ts(3,4): err", False, _at(1))]
    stateful.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    out = []
    logs = assembly.assembled(stateful.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = analyse(logs, lambda df, n: out.extend(df.where("role = 'own'").select("log_id", "tool", "file", "line", "message").collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in out] == [("a", "tsc", "src/a.ts", 3, "three")]
