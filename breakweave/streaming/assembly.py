"""Whole logs from a stream of their chunks: state by log, closed when the log is complete or when its chunks have stopped coming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "log_id string, raw string, argv array<string>, complete boolean, chunks int, missing int"
#: The state store that keeps the chunks of open logs on the executors' disks.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Assembler(StatefulProcessor):
    """The chunks of one log: a map from number to text, so that a batch writes only the chunks that it brings, and the facts that say when the log closes."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk int", "raw string")
        # held: how many chunks; final: the number of the last chunk, -1 while unknown; timer: when the log closes
        self.facts = handle.getValueState("facts", "held int, final int, timer long")

    def _close(self, key: tuple, final: int) -> pd.DataFrame:
        texts = {k[0]: v[0] for k, v in self.parts.iterator()}
        missing = max(final, *texts) + 1 - len(texts)
        self.parts.clear()
        self.facts.clear()
        raw = "".join(texts[k] for k in sorted(texts))
        return pd.DataFrame({"log_id": [key[0]], "raw": [raw], "argv": [None], "complete": [final >= 0 and missing == 0], "chunks": pd.array([len(texts)], "int32"), "missing": pd.array([missing], "int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, final, timer = self.facts.get() if self.facts.exists() else (0, -1, 0)
        newest = 0
        for batch in rows:
            for chunk, raw, last, ts in zip(batch["chunk"], batch["raw"], batch["last"], batch["ts"], strict=True):
                number = (int(chunk),)
                if not self.parts.containsKey(number):
                    self.parts.updateValue(number, (raw or "",))
                    held += 1
                if last:
                    final = max(final, int(chunk))
                newest = max(newest, int(ts.timestamp() * 1000))
        if final >= 0 and held == final + 1:
            if timer:
                self.handle.deleteTimer(timer)
            yield self._close(key, final)
            return
        due = max(newest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms
        if due > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.facts.update((held, final, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.facts.exists():
            yield self._close(key, self.facts.get()[1])

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, wait_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Whole logs of a stream of chunks (log_id, chunk from 0 on, raw, last, ts): log_id, raw, argv, complete, chunks, missing, which streaming.logs.analyse takes.

    A log leaves in the batch that brings the last of its chunks, in whatever order they come; one whose chunks stop coming leaves when the watermark has passed the newest of them by
    wait_seconds, with what is there and the number that is missing. The session needs the state store STORE.

    Defined cases: a chunk number that comes again is kept as it came first; null texts are empty; rows without a log or a number are left out; a chunk that comes after its log has left
    opens a further log of that id, so nothing is lost but what Spark drops behind the watermark. A log must fit a row; larger ones go through operators.pieces as they come.
    """
    rows = chunks.where("log_id is not null and chunk is not null and ts is not null").select("log_id", F.col("chunk").cast("int").alias("chunk"), "raw", F.coalesce("last", F.lit(False)).alias("last"), "ts")
    dealt = rows.withWatermark("ts", late).groupBy("log_id")
    return dealt.transformWithStateInPandas(Assembler(1000 * wait_seconds), LOG, "Append", "EventTime")
