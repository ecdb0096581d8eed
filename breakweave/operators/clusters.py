"""Likely causes: failures of one shape grouped under a deterministic fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def keyed(failures: DataFrame) -> DataFrame:
    """Adds signature (the message's shape), score and cause (24 hex digits of the key's SHA-256)."""
    rows = failures.withColumn("signature", T.skeleton(F.col("message"))).withColumn("score", T.content_score(F.col("signature")))
    key = F.to_json(F.array(F.coalesce("code", "label", F.lit("")), "signature"))
    return rows.withColumn("cause", T.fingerprint(key))


def clusters(failures: DataFrame, least_size: int = 3, least_score: int = 2) -> DataFrame:
    """(log_id, tool, id, signature, size, members, exemplar, reported).

    A shape with enough members and content is one cluster; others fall into one cluster a failure. The exemplar is the first member with a place.
    """
    rows = keyed(failures)
    member = F.struct("ord", F.when(F.col("line").isNotNull(), F.col("ord")).alias("placed"))
    groups = rows.groupBy("log_id", "tool", "cause", "signature", "score").agg(F.sort_array(F.collect_list(member)).alias("m"))
    groups = groups.withColumn("reported", (F.size("m") >= least_size) & (F.col("score") >= least_score))
    whole = F.array(F.struct(F.col("cause").alias("id"), F.col("m").alias("m")))
    single = F.transform("m", lambda x: F.struct(T.fingerprint(F.concat(F.col("cause"), F.lit(":"), x["ord"].cast("string"))).alias("id"), F.array(x).alias("m")))
    parts = groups.select("log_id", "tool", "signature", "reported", F.inline(F.when(F.col("reported"), whole).otherwise(single)))
    members = F.transform("m", lambda x: x["ord"])
    return parts.select("log_id", "tool", "id", "signature", F.size("m").alias("size"), members.alias("members"), F.coalesce(F.array_min(F.transform("m", lambda x: x["placed"])), F.array_min(members)).alias("exemplar"), "reported")


def causes(failures: DataFrame) -> DataFrame:
    """Over all logs: how many logs and failures each cause has; partial sums before the shuffle, so one common cause is no hot key."""
    rows = keyed(failures)
    return rows.groupBy("tool", "cause", "signature").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("log_id").alias("logs"))


def rollup(failures: DataFrame) -> DataFrame:
    """Failures by category and tool with subtotals."""
    return failures.rollup("category", "tool").agg(F.count(F.lit(1)).alias("failures"))
