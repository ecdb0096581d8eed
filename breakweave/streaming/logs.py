"""Logs as a stream: whole logs that arrive as files or rows are analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.report import analysed


def read(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Text files of a folder as they arrive, a log each; the limit on files is the back-pressure."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.input_file_name().alias("log_id"), F.col("value").alias("raw"), F.lit(None).cast("array<string>").alias("argv"))


def analyse(logs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the batch plan on each micro-batch and hands its failures to sink, which can make each batch number count once.

    The plan reads a batch more than once, so it is kept for that time: a stateful step before it (assembly) runs once a batch.
    """
    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            sink(analysed(batch), n)
        finally:
            batch.unpersist()

    return logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def error_rates(lined: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines and error lines by window of a stream of lines (ts, text), with a watermark for late ones."""
    hit = F.col("text").rlike(r"(?i)\b(error|fatal|failed|panic)\b")
    return lined.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("lines"), F.sum(hit.cast("int")).alias("errors"))
