"""Formatters that print what they would change as a diff: each hunk is a failure, at the first line that would change.

Only the lines with a role become rows (headers, hunks, removed and added lines, what ends a body); context lines are counted by the numbers of the lines around them. A diff's hunks
are ordered and disjoint, so one that does not begin after the hunks before it is another diff's and no place; nor is one whose first removed line lies beyond the length that the
hunk itself declares. A file without any hunk that counts is one failure without a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .readers import FIELDS, Reader

KINDS = ("head", "close", "hunk", "minus", "plus", "stop")
HUNK = r"^@@[ \t]+-(\d+)(?:,(\d+))?[ \t]+\+\d+(?:,\d+)?[ \t]+@@"


def tries(r: Reader) -> list[tuple[str, str, tuple[str, ...]]]:
    """What a line may be to a reader of hunks: the first of these. A rule of --- that is not the reader's own begins a diff of someone else."""
    return [("head", r.pattern, r.groups), ("close", r.block.hunks, ()), ("hunk", HUNK, ("line", "col")), ("minus", "^-", ()), ("plus", r"^\+", ()), ("stop", "^(?! )", ())]


def places(found: DataFrame, readers: tuple[Reader, ...]) -> DataFrame:
    """(log_id, reader, fields, line_no, n, start, end) of every hunk, in rows of hits dealt by log."""
    mine = [i for i, r in enumerate(readers) if r.block and r.block.hunks]
    kind, at = F.col("kind"), F.col("line_no")
    log = Window.partitionBy("log_id", "reader").orderBy("line_no")
    rows = found.where(F.col("reader").isin(mine) & kind.isin(*KINDS)).select(
        "log_id", "reader", "line_no", "kind", "file", "line", "col",
        F.last(F.when(kind == "head", F.col("file")).when(kind == "close", F.lit("")), ignorenulls=True).over(log).alias("name"),
        F.last(F.when(kind.isin("head", "close"), at), ignorenulls=True).over(log).alias("header"), F.sum(kind.isin("head", "close", "hunk").cast("int")).over(log).alias("part"),
    )
    rows = rows.where("name <> ''")
    part = Window.partitionBy("log_id", "reader", "part")
    rows = rows.withColumn("stopped", F.min(F.when(kind == "stop", at)).over(part)).where("kind = 'stop' or stopped is null or line_no < stopped")
    rows = rows.withColumn("gone", F.min(F.when(kind == "minus", at)).over(part))
    got = rows.groupBy("log_id", "reader", "part", "name", "header", "stopped", "gone").agg(
        F.max(F.when(kind.isin("head", "hunk"), F.struct("kind", "line_no", F.col("line").cast("long").alias("begins"), F.col("col").cast("long").alias("length")))).alias("o"),
        F.min(F.when(kind == "plus", at)).alias("new"), F.count_if((kind == "plus") & (at < F.col("gone"))).alias("added"), F.max(F.when(kind.isin("minus", "plus"), at)).alias("last"),
    )
    file = Window.partitionBy("log_id", "reader", "header")
    hunk = F.col("o.kind") == "hunk"
    first = F.coalesce("gone", "new", F.col("o.line_no") + 1)
    got = got.withColumn("changed", F.col("o.begins") + first - F.col("o.line_no") - 1 - F.when(F.col("gone").isNotNull(), F.col("added")).otherwise(0))
    got = got.withColumn("seen", F.max("o.begins").over(file.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead("o.line_no").over(Window.partitionBy("log_id", "reader").orderBy("part")))
    sound = F.coalesce(F.col("o.begins") > F.col("seen"), F.lit(True)) & (F.col("gone").isNull() | (F.col("changed") < F.col("o.begins") + F.coalesce("o.length", F.lit(1))))
    got = got.withColumn("sound", hunk & sound).withColumn("any", F.max("sound").over(file)).where("sound or (o.kind = 'head' and not any)")
    known = {"file": F.col("name"), "line": F.when(F.col("sound"), F.col("changed").cast("string"))}
    end = F.when(F.col("sound"), F.coalesce(F.least("stopped", "next") - 1, "last", "o.line_no")).otherwise(F.col("header"))
    return got.select(
        "log_id", "reader", *(known.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS), F.col("o.line_no").alias("line_no"), F.lit(0).alias("n"), F.col("header").alias("start"), end.alias("end"),
    )
