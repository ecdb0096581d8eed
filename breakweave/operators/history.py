"""What is new and what is gone since the previous run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .clusters import keyed

VERSION = 6


def identity(logs: DataFrame) -> DataFrame:
    """(log_id, identity): the same for runs of one command in one folder; null for an unnamed pipe."""
    named = F.coalesce("run_key", F.when(F.size("argv") > 0, F.to_json(F.struct("cwd", "argv"))))
    return logs.select("log_id", F.when(named.isNotNull(), T.fingerprint(F.concat(F.lit(f"{VERSION}:"), named))).alias("identity"))


def tracked(failures: DataFrame, identities: DataFrame) -> DataFrame:
    """(identity, log_id, tool, cause) of each run's causes; one too plain to tell apart keeps its subject or title."""
    rows = keyed(failures)
    exact = F.when(rows["score"] < 2, T.fingerprint(F.concat_ws("|", "cause", F.coalesce("subject", "title")))).otherwise(F.col("cause"))
    return rows.select("log_id", "tool", T.fingerprint(F.concat_ws("|", "tool", exact)).alias("cause")).distinct().join(identities, "log_id")


def records(tracked_causes: DataFrame, ran_at: F.Column) -> DataFrame:
    """A record of each named run: identity, version, ran_at, tool, causes. Runs without identity leave none."""
    rows = tracked_causes.where("identity is not null").groupBy("identity", "tool").agg(F.sort_array(F.collect_set("cause")).alias("causes"))
    return rows.select("identity", F.lit(VERSION).alias("version"), ran_at.cast("timestamp").alias("ran_at"), "tool", "causes")


def write(rows: DataFrame, path: str) -> None:
    """Appends records to the history; earlier ones stay, and latest finds the last of each identity."""
    rows.write.mode("append").parquet(path)


def latest(history: DataFrame) -> DataFrame:
    """The last valid record of each identity. history: identity, version, ran_at, tool, causes."""
    ok = history.where((F.col("version") == VERSION) & F.forall("causes", lambda c: c.rlike("^[0-9a-f]{24}$")))
    w = Window.partitionBy("identity").orderBy(F.desc("ran_at"))
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def compared_runs(causes: DataFrame, now: F.Column) -> DataFrame:
    """(identity, fresh, same, gone): counts of causes. causes: identity, cause of both runs, read once; now tells the current run's rows."""
    seen = causes.groupBy("identity", "cause").agg(F.bool_or(now).alias("now"), F.bool_or(~now).alias("then"))
    return seen.groupBy("identity").agg(*(F.count_if(c).alias(n) for n, c in (("fresh", ~F.col("then")), ("same", F.col("then") & F.col("now")), ("gone", ~F.col("now")))))


def compared(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The same for two tables of identity and cause."""
    both = (x.select("identity", "cause", F.lit(k).alias("current")) for x, k in ((current, True), (previous, False)))
    return compared_runs(next(both).unionByName(next(both)), F.col("current"))
