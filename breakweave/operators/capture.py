"""Bounded capture: the head and tail of a log, and the likely diagnostics between them; what is left out can be marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERESTING = r"(?i)\b(?:error|fatal|fail(?:ed|ure)?|panic|exception|traceback|undefined|cannot|not found|denied|conflict|assert\w*)\b|^\s*(?:✘|✖|×|●|E )|\bnot ok\b"


def _judged(lined: DataFrame, budget: int, context: int) -> DataFrame:
    """lined with size, whether a line is kept, rescued and truncated."""
    log = Window.partitionBy("log_id")
    up, down = log.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0), log.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    near = log.orderBy("line_no").rowsBetween(-context, context)
    rows = lined.withColumn("size", F.length("text") + 1)
    rows = rows.withColumn("head", F.sum("size").over(up)).withColumn("tail", F.sum("size").over(down))
    rows = rows.withColumn("total", F.col("head") + F.col("tail") - F.col("size")).withColumn("likely", F.max(F.col("text").rlike(INTERESTING)).over(near))
    ends = (F.col("head") <= budget // 4) | (F.col("tail") <= budget // 2)
    rows = rows.withColumn("ends", (F.col("total") <= budget) | ends)
    extra = F.sum(F.when(~F.col("ends") & F.col("likely"), F.col("size")).otherwise(0)).over(up)
    rows = rows.withColumn("rescued", ~F.col("ends") & F.col("likely") & (extra <= budget // 4)).withColumn("truncated", F.col("total") > budget)
    return rows.withColumn("kept", F.col("ends") | F.col("rescued")).drop("head", "tail", "total", "likely", "ends")


def captured(lined: DataFrame, budget: int, context: int = 8) -> DataFrame:
    """Lines of each log within budget characters: the first quarter, half at the end, and up to a quarter of likely diagnostics with their context.

    Adds rescued and truncated; line_no stays that of the whole log. A log within the budget is kept as it is.
    """
    return _judged(lined, budget, context).where("kept").drop("kept", "size")


def elided(lined: DataFrame, budget: int, context: int = 8) -> DataFrame:
    """As captured, with a marker (log_id, line_no, text, and elided, the characters that it stands for) in place of every run of lines left out, at its first line.

    Without it the head of one failure and the tail of another would stand together and be read as one. A marker is a line that no reader reads.
    """
    up = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _judged(lined, budget, context).withColumn("run", F.sum(F.col("kept").cast("int")).over(up))
    # a run of lines left out follows one kept line (or none), so that line's number is the run's; the gap is one row, made where the lines lie
    gaps = rows.where("not kept").groupBy("log_id", "run").agg(F.min("line_no").alias("line_no"), F.sum("size").alias("elided"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("~~~ "), F.col("n").cast("string"), F.lit(" lines, "), F.col("elided").cast("string"), F.lit(" characters left out ~~~"))
    none = rows.where("kept").select("log_id", "line_no", "text", F.lit(0).cast("long").alias("elided"))
    return none.unionByName(gaps.select("log_id", "line_no", text.alias("text"), "elided"))
