"""Logs of any size from files, in rows of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gathered(size: int):
    """Function over Arrow batches of (path, block, text), lines in order: lines of one path and block as texts of about size characters, numbered within the block."""
    names = ["log_id", "block", "part", "raw"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held, n = None, 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, part, "\n".join(held)), types, strict=True)], names)
        for batch in batches:
            for path, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((path, block) != key or n >= size):
                    yield row()
                    part, held, n = part + 1, [], 0
                if (path, block) != key:
                    key, part = (path, block), 0
                held.append(text)
                n += len(text) + 1
        if held:
            yield row()

    return run


def read_chunks(spark: SparkSession, path: str, size: int = 4 << 20) -> DataFrame:
    """(log_id, chunk, raw) of the text files under path, for operators.pieces: a file is read in as many splits as Spark makes of it, and a split leaves as rows of about size characters.

    Lines end at \\n alone and belong to the split in which they begin; a chunk is (where its split begins, its number in there), which orders a file's rows. A task holds one row's
    text and one Arrow batch. A line must fit a row. An empty file has no rows; the end of a last line doesn't begin another.
    """
    lined = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").load(path)
    lined = lined.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = lined.mapInArrow(gathered(size), "log_id string, block long, part int, raw string")
    return rows.select("log_id", F.struct("block", "part").alias("chunk"), "raw")
