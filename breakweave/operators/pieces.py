"""Logs too large for a row: a log in many rows, each some of its lines, gives the failures that it would give in one.

What is decided for a log as a whole (which readers are asked, the prefix of its lines, how many lines lie before a row) comes from small facts of its rows: these meet by log, the
texts never do. Each row then learns its share of the decision by its own key, so that no join has a hot one, however large a log is. Hits are shuffled by log, as for other logs.

Defined cases: null texts are empty rows of one line; a log's rows are told apart by chunk, in whose order they stand, and no two may be equal. A document must lie within one
row, and so must the quoted step of a container build; that a log is one text twice isn't looked for: what a retry says again is the same failure, with the places of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parsing
from .readers import READERS, Reader

#: The physical lines of a log that its gates look at, and how many of those that aren't blank.
HEAD, SAMPLE = 400, 200
_PATTERNS = (parsing.CI_STAMP, *(p for _, p in parsing.WRAPPERS))


def _marks(raw: Column) -> Column:
    """Which gates' patterns each of the first lines holds, a bit each; the first bit is that the line isn't blank."""
    bits = lambda x: sum((F.when(x.rlike(p), 2 << i).otherwise(0) for i, p in enumerate(_PATTERNS)), F.when(F.trim(x) != "", 1).otherwise(0))
    return F.transform(F.slice(F.split(raw, "\n", -1), 1, HEAD), lambda x: bits(x).cast("int"))


def decided(rows: DataFrame, readers: tuple[Reader, ...] = READERS, share: float = 0.4) -> DataFrame:
    """(log_id, chunk, asked, prefix, first) of every row of normalised logs."""
    facts = parsing.routed(rows, readers).select("log_id", "chunk", "asked", _marks(F.col("raw")).alias("marks"), F.size(F.split("raw", "\n", -1)).cast("long").alias("n"))
    log = Window.partitionBy("log_id")
    before = log.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # rows that begin after the lines which the gates look at have no say in them
    seen = F.when(F.col("first") < HEAD, F.struct("chunk", "marks"))
    facts = facts.withColumn("asked", F.sort_array(F.array_distinct(F.flatten(F.collect_set("asked").over(log))))).withColumn("seen", F.sort_array(F.collect_list(seen).over(log)))
    head = F.slice(F.filter(F.slice(F.flatten(F.transform("seen", lambda s: s["marks"])), 1, HEAD), lambda x: x.bitwiseAND(1) > 0), 1, SAMPLE)
    facts = facts.withColumn("head", head)
    bit = {p: 2 << i for i, p in enumerate(_PATTERNS)}
    rate = lambda p: F.size(F.filter("head", lambda x: x.bitwiseAND(F.lit(bit[p])) > 0)) / F.greatest(F.size("head"), F.lit(1))
    return facts.select("log_id", "chunk", "asked", parsing._gate(rate, share).alias("prefix"), "first")


def parsed(chunks: DataFrame, readers: tuple[Reader, ...] = READERS, documents=None) -> DataFrame:
    """As parsing.parsed, of logs in many rows. chunks: log_id, chunk (anything that orders a log's rows), raw: whole lines, without the last one's end."""
    # where lines end by CR and LF, the cut took the LF alone
    rows = parsing.normalised(chunks.select("log_id", "chunk", F.regexp_replace("raw", r"\r\z", "").alias("raw")), retries=False)
    rows = rows.join(decided(rows, readers), ["log_id", "chunk"])
    return parsing.read(parsing.unwrapped(rows), readers, documents)


def cut(logs: DataFrame, lines: int) -> DataFrame:
    """Logs as rows of so many lines: log_id, chunk, raw."""
    parts = F.split(F.coalesce("raw", F.lit("")), "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / lines).cast("int"))
    rows = logs.select("log_id", parts.alias("parts")).select("log_id", "parts", F.explode(starts).alias("chunk"))
    return rows.select("log_id", "chunk", F.array_join(F.slice("parts", F.col("chunk") * lines + 1, F.lit(lines)), "\n").alias("raw"))
