"""What a log's own reader said already, where a log has many failures: joins by keys and sorted intervals, in place of all pairs of a log.

Said are, as in ownership: failures at a place with the same message, or with one title and one message the other's beginning; messages that equal, hold or lie in
an own one whose lines overlap; and failures without place whose message one with a place holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4
#: Messages of WINDOW characters or more are looked up by marks: of each window of so many, the run of MARK characters with the lowest hash.
MARK, WINDOW = 8, 16
FACTS = ("file", "line", "col", "code", "title", "message", "places")


def base(c: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(c, r"[/\\]"), -1)


def bare(c: Column) -> Column:
    """A message without the bracketed code and full stop at its end."""
    return F.regexp_replace(F.trim(c), r"[.\s]*(?:\[[^\]]*\][.\s]*)?$", "")


def _runs() -> str:
    return f"array_distinct(transform(sequence(1, length(message) - {GRAM - 1}), i -> xxhash64(substr(message, i, {GRAM}))))"


def _marks() -> str:
    width = WINDOW - MARK + 1
    hashes = f"transform(sequence(1, length(message) - {MARK - 1}), i -> xxhash64(substr(message, i, {MARK})))"
    # a one-element array binds the hashes to h, so that they are made once
    return f"get(transform(array({hashes}), h -> array_distinct(transform(sequence(1, size(h) - {width - 1}), i -> array_min(slice(h, i, {width}))))), 0)"


def _by_rarest(parts: DataFrame, wholes: DataFrame, runs: str) -> DataFrame:
    """(log_id, part, whole) where the whole has the part's run that the fewest wholes of the log have; a part with a run that no whole has is in none."""
    index = wholes.select("log_id", F.col("message").alias("whole"), F.explode(F.expr(runs)).alias("run"))
    often = index.groupBy("log_id", "run").agg(F.count(F.lit(1)).alias("n"))
    asked = parts.select("log_id", F.col("message").alias("part"), F.explode(F.expr(runs)).alias("run"))
    rarest = asked.join(often, ["log_id", "run"], "left").groupBy("log_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least"))
    return rarest.where("least.n > 0").select("log_id", "part", F.col("least.run").alias("run")).join(index, ["log_id", "run"]).select("log_id", "part", "whole")


def held(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(log_id, part, whole) of all different messages where the whole holds the part; parts and wholes: (log_id, message), distinct.

    A part looks its rarest run of GRAM characters up among those of the log's wholes; one whose runs no whole has is done. Long parts have few marks in place of all their runs: a whole
    that holds a part holds each of its windows and so each of its marks. Shorter parts are looked up as they are.
    """
    size = F.length("message")
    mid = parts.where((size >= GRAM) & (size < WINDOW))
    by_run = _by_rarest(mid, wholes.where(size >= GRAM).join(mid.select("log_id").distinct(), "log_id", "left_semi"), _runs())
    by_mark = _by_rarest(parts.where(size >= WINDOW), wholes.where(size >= WINDOW), _marks())
    few = parts.where(f"length(message) < {GRAM}").select("log_id", F.col("message").alias("part"))
    pieces = F.expr(f"array_distinct(flatten(transform(sequence(0, {GRAM - 1}), n -> transform(sequence(1, greatest(length(message), 1)), i -> substr(message, i, n)))))")
    short = wholes.join(few.select("log_id").distinct(), "log_id", "left_semi").select("log_id", F.col("message").alias("whole"), F.explode(pieces).alias("part")).join(few, ["log_id", "part"])
    found = by_run.unionByName(by_mark).unionByName(short.select("log_id", "part", "whole"))
    return found.where("part <> whole and contains(whole, part)")


def overlapping(rest: DataFrame, own: DataFrame) -> DataFrame:
    """(log_id, key) of rest with a place that overlaps an own one of the same message: the furthest end of the own places that begin by its end is not before its start."""
    spans = own.select("log_id", "message", F.explode("places").alias("p")).select("log_id", "message", F.lit(None).cast("string").alias("key"), F.col("p.start").alias("at"), F.col("p.start").alias("start"), F.col("p.end").alias("upto"))
    asked = rest.select("log_id", "message", "key", F.explode("places").alias("p")).select("log_id", "message", "key", F.col("p.end").alias("at"), F.col("p.start").alias("start"), F.lit(None).cast("int").alias("upto"))
    until = Window.partitionBy("log_id", "message").orderBy("at", F.col("key").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return spans.unionByName(asked).withColumn("far", F.max("upto").over(until)).where("key is not null and far >= start").select("log_id", "key")


def located(rest: DataFrame, own: DataFrame) -> DataFrame:
    """(log_id, key) of rest at the place of an own failure that says the same."""
    facts = lambda rows, side: rows.where("file is not null and message is not null").select(
        "log_id", *(["key"] if side == "r" else []), base(F.col("file")).alias("base"), F.coalesce(F.col("line").cast("long"), F.lit(-1)).alias("row"), bare(F.col("message")).alias("bare"),
        *(F.col(c).alias(f"{side}_{c}") for c in ("file", "col", "code", "title", "message")),
    )
    r, m = facts(rest, "r"), facts(own, "m")
    fits = F.expr("(endswith(r_file, m_file) or endswith(m_file, r_file)) and (r_col is null or m_col is null or r_col = m_col) and (r_code is null or m_code is null or r_code = m_code)")
    spot = ["log_id", "base", "row"]
    same = r.join(m, [*spot, "bare"]).where(fits)
    # beginnings are looked up at the lengths that messages of the place and title have
    mine, theirs = m.drop("bare").withColumn("title", F.col("m_title")), r.drop("bare").withColumn("title", F.col("r_title"))

    def begun(whole: DataFrame, w: str, part: DataFrame, p: str) -> DataFrame:
        lengths = part.groupBy(*spot, "title").agg(F.collect_set(F.length(f"{p}_message")).alias("lengths"))
        cut = whole.join(lengths, [*spot, "title"]).select("*", F.explode(F.expr(f"filter(lengths, n -> n < length({w}_message))")).alias("n"))
        return cut.withColumn("begin", F.expr(f"left({w}_message, n)")).join(part.withColumn("begin", F.col(f"{p}_message")), [*spot, "title", "begin"]).where(fits).select("log_id", "key")

    return same.select("log_id", "key").unionByName(begun(theirs, "r", mine, "m")).unionByName(begun(mine, "m", theirs, "r"))


def said(rest: DataFrame, own: DataFrame) -> DataFrame:
    """(log_id, key) of the failures in rest (log_id, key, FACTS) that own ones (log_id, FACTS) of their log say. No messages: nothing is said."""
    rest, own = rest.where("message is not null"), own.where("message is not null").distinct()
    asks, says = rest.where(f"length(message) >= {GRAM}").select("log_id", "message").distinct(), own.select("log_id", "message").distinct()
    within = held(asks, says).select("log_id", F.col("part").alias("message"), F.col("whole").alias("theirs"))
    around = held(says, asks).select("log_id", F.col("whole").alias("message"), F.col("part").alias("theirs"))
    alike = own.select("log_id", F.col("message").alias("theirs"), "places").join(within.unionByName(around), ["log_id", "theirs"]).select("log_id", "message", "places")
    by_text = overlapping(rest, own.select("log_id", "message", "places").unionByName(alike))
    placed = own.where("file is not null").select("log_id", "message").distinct()
    through = within.join(placed.withColumnRenamed("message", "theirs"), ["log_id", "theirs"], "left_semi").select("log_id", "message")
    echoed = rest.where(f"file is null and length(message) >= {GRAM}").join(placed.unionByName(through), ["log_id", "message"], "left_semi").select("log_id", "key")
    return located(rest, own).unionByName(by_text).unionByName(echoed).distinct()
