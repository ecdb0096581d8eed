"""Logs from files, and logs rendered from order tables in the formats of the tools."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.readers import READERS, Reader

LOG = "log_id string, raw string, argv array<string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A log for each text file under path."""
    rows = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.input_file_name().alias("log_id"), F.col("value").alias("raw"), F.lit(None).cast("array<string>").alias("argv"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that a rendered diagnostic has, one row a lineitem."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return rows.select(
        "l_orderkey", F.concat(F.lit("src/m"), (F.col("l_partkey") % 97).cast("string")).alias("file"), F.col("l_linenumber").cast("string").alias("line"), (F.col("l_suppkey") % 90 + 1).cast("string").alias("col"),
        F.concat(F.lit("K"), (F.col("l_partkey") % 5).cast("string")).alias("code"), F.concat(F.lit("case_"), F.col("l_linenumber").cast("string")).alias("subject"),
        F.concat(F.lit("value "), F.col("l_quantity").cast("int").cast("string"), F.lit(" too large")).alias("message"),
    )


#: The same facts in SQL.
ITEMS = """select l_orderkey, 'src/m' || (l_partkey % 97) as file, cast(l_linenumber as varchar) as line, cast(l_suppkey % 90 + 1 as varchar) as col, 'K' || (l_partkey % 5) as code,
 'case_' || l_linenumber as subject, 'value ' || cast(floor(l_quantity) as int) || ' too large' as message from lineitem"""


def sample(reader: Reader, of=F.col) -> Column:
    """The lines of one diagnostic of the reader's tool; of gives a fact by its name."""
    parts = [F.lit(x) if i % 2 == 0 else of(x) for i, x in enumerate(re.split(r"\{(\w+)\}", "\n".join(reader.sample)))]
    return F.concat(*parts)


def rendered(spark: SparkSession, sf_dir: str, readers: tuple[Reader, ...] | None = None, key: int = 1) -> DataFrame:
    """A log for each order, with a diagnostic for each of its lineitems; orders take the readers in turn by l_orderkey % key."""
    readers = readers or READERS
    # rows are dealt by log_id, as everything after goes by it, and lines are written where the facts have met
    parts = items(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("log_id"), F.struct("line", "file", "col", "message", "code", "subject").alias("p"))
    logs = parts.groupBy("log_id").agg(F.collect_list("p").alias("ps"))

    def text(p: Column) -> Column:
        out = sample(readers[0], lambda x: p[x])
        for i, r in enumerate(readers[1:], 1):
            out = F.when(F.col("log_id").cast("long") % key == i, sample(r, lambda x: p[x])).otherwise(out)
        return out

    raw = F.array_join(F.transform(F.sort_array("ps"), text), "\n")
    return logs.select("log_id", raw.alias("raw"), F.lit(None).cast("array<string>").alias("argv"), F.lit(1).alias("exit_code"), F.lit(None).cast("string").alias("signal"))
