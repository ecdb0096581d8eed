"""What people read of a report: causes in order, sites, a summary in markdown, declared counts, source snippets and the raw fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import keyed
from .report import _escaped

#: Counts that tools declare at the end of a run.
DECLARED = r"(?m)^(?:Found |[^\w\n]*)(\d+) (?:errors?|failed|failures?|failing|problems?)\b"
MOST_SOURCE_BYTES = 2 * 1024 * 1024


def ordered(clusters: DataFrame, most: int = 5) -> DataFrame:
    """Adds rank, the order of a log's clusters (reported ones first, large before small, then by first member), and shown, whether it is among the most first."""
    size = F.when(F.col("reported"), F.col("size")).otherwise(0)
    w = Window.partitionBy("log_id").orderBy(F.desc("reported"), F.desc(size), "exemplar", "id")
    return clusters.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= most)


def sites(failures: DataFrame, most: int = 3, room: int = 200) -> DataFrame:
    """(log_id, tool, cause, cases, sites, first_sites, headline): how many places each cause of a log has; the first of them, at most so many and within room characters."""
    site = F.concat_ws(":", "file", "line", "col")
    rows = keyed(failures).groupBy("log_id", "tool", "cause").agg(F.count(F.lit(1)).alias("cases"), F.array_sort(F.collect_set(F.when(F.col("file").isNotNull(), site))).alias("s"))
    first = F.slice("s", 1, most)
    used = lambda i: F.aggregate(F.slice(first, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x) + 2)
    rows = rows.withColumn("sites", F.size("s")).withColumn("first_sites", F.filter(first, lambda x, i: used(i) - 2 <= room)).drop("s")
    noun = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    headline = F.when(F.col("sites") == F.col("cases"), noun(F.col("sites"), "site")).when(F.col("sites") == 0, noun(F.col("cases"), "case")).otherwise(F.concat(noun(F.col("cases"), "case"), F.lit(" at "), noun(F.col("sites"), "site")))
    return rows.withColumn("headline", headline)


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def markdown(report: DataFrame, unfolded: int = 10) -> DataFrame:
    """(log_id, markdown) of reports: a heading, a section a failure, those after the first few folded, and what other tools add."""

    def section(f: Column) -> Column:
        place = F.concat_ws(":", f["file"], f["line"], f["col"])
        mark = fence(f["message"])
        title = F.regexp_replace(f["title"], r"([\\`*_<>\[\]])", r"\\$1")
        return F.concat(F.lit("**"), title, F.lit("**"), F.when(place != "", F.concat(F.lit(" `"), place, F.lit("`"))).otherwise(""), F.lit("\n"), mark, F.lit("text\n"), f["message"], F.lit("\n"), mark)

    each = F.transform("failures", section)
    rest = F.size("failures") - unfolded
    folded = F.when(rest > 0, F.concat(F.lit("\n\n<details><summary>"), rest.cast("string"), F.lit(" more</summary>\n\n"), F.array_join(F.slice(each, unfolded + 1, F.greatest(rest, F.lit(1))), "\n\n"), F.lit("\n\n</details>"))).otherwise("")
    others = F.transform("others", lambda o: F.concat(F.lit("- "), o["tool"], F.lit(": "), o["count"].cast("string"), F.lit(" more")))
    more = F.when(F.size("others") > 0, F.concat(F.lit("\n\nAlso reported:\n"), F.array_join(others, "\n"))).otherwise("")
    text = F.concat(F.lit("## "), F.col("tool"), F.lit(": "), F.col("summary"), F.lit("\n\n"), F.array_join(F.slice(each, 1, unfolded), "\n\n"), folded, more)
    return report.select("log_id", F.coalesce(text, F.concat(F.lit("No failure was read ("), "fallback", F.lit(")."))).alias("markdown"))


def raw_fallback(logs: DataFrame, budget: int = 3500) -> DataFrame:
    """(log_id, annotation, cut) of each log: the beginning of its output as one annotation of at most budget bytes, no escape or character split."""
    head, tail = "::notice title=captured output::", " [preview truncated]"
    room = budget - len(head) - len(tail) - 1
    size = lambda c: F.octet_length(_escaped(c, False))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"))

    def step(acc: Column, char: Column) -> Column:
        after = F.when(acc["bytes"] < 0, -1).otherwise(F.when(acc["bytes"] + size(char) > room, -1).otherwise(acc["bytes"] + size(char)))
        return F.struct((acc["n"] + (after >= 0).cast("int")).alias("n"), after.alias("bytes"))

    # each character is a byte at least, so more than room of them are never looked at
    seen = F.coalesce(F.substring("raw", 1, room + 1), F.lit(""))
    kept = F.aggregate(F.split(seen, ""), start, step)
    rows = logs.select("log_id", seen.alias("seen"), kept.alias("kept"))
    text = _escaped(F.substring("seen", F.lit(1), F.col("kept.n")), False)
    cut = F.col("kept.bytes") < 0
    return rows.select("log_id", F.concat(F.lit(head), text, F.when(cut, tail).otherwise("")).alias("annotation"), cut.alias("cut"))


def tallies(logs: DataFrame, failures: DataFrame) -> DataFrame:
    """(log_id, declared, found, unread): the failures that a log's closing lines declare, summed over repeated runs, against those read. Null without such lines."""
    numbers = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(DECLARED), F.lit(1))
    declared = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))))
    found = failures.groupBy("log_id").agg(F.count(F.lit(1)).alias("found"))
    rows = logs.select("log_id", declared.alias("declared")).join(found, "log_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))
    return rows.withColumn("unread", F.col("declared") > F.col("found"))


def snippets(failures: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds has_line (null without a source) and snippet, the numbered lines around each failure. sources: path, text; a path occurs once.

    The less a message says, the more lines are shown, one to four on each side; wide ones end at blank lines. Only the given sources are ever read, by equal path,
    and none above 2 MiB.
    """
    known = sources.where(F.octet_length("text") <= MOST_SOURCE_BYTES).select(F.col("path").alias("file"), F.col("text").alias("source"))
    rows = failures.join(known, "file", "left").withColumn("all", F.split("source", "\r?\n", -1))
    said = F.trim(F.coalesce("message", F.lit("")))
    tall = F.size(F.filter(F.split(said, "\n"), lambda x: F.trim(x) != "")) >= 3
    ctx = F.when(said == "", 3).when(tall | (F.length(said) >= 70), 1).when(F.length(said) >= 40, 2).otherwise(4)
    rows = rows.withColumn("has_line", F.when(F.col("source").isNotNull() & F.col("line").isNotNull(), F.col("line") <= F.size("all"))).withColumn("ctx", ctx)
    near = F.transform(F.sequence(F.greatest(F.lit(1), F.col("line") - F.col("ctx")), F.least(F.size("all"), F.col("line") + F.col("ctx"))), lambda n: F.struct(n.alias("n"), F.get("all", n - 1).alias("text")))
    rows = rows.withColumn("near", F.when(F.col("has_line"), near))
    blank = lambda x: F.trim(x["text"]) == ""
    at = lambda keep: F.transform(F.filter("near", keep), lambda x: x["n"])
    wide = F.col("ctx") > 2
    above, below = F.array_max(at(lambda x: wide & blank(x) & (x["n"] < F.col("line")))), F.array_min(at(lambda x: wide & blank(x) & (x["n"] > F.col("line"))))
    rows = rows.withColumn("above", F.coalesce(above, F.lit(0))).withColumn("below", F.coalesce(below, F.lit(2**31 - 1)))
    full = at(lambda x: (x["n"] > F.col("above")) & (x["n"] < F.col("below")) & (~blank(x) | (x["n"] == F.col("line"))))
    rows = rows.withColumn("from", F.array_min(full)).withColumn("to", F.array_max(full))
    shown = F.transform(F.filter("near", lambda x: (x["n"] >= F.col("from")) & (x["n"] <= F.col("to"))), lambda x: F.concat(F.when(x["n"] == F.col("line"), "> ").otherwise("  "), x["n"].cast("string"), F.lit(" | "), x["text"]))
    return rows.withColumn("snippet", F.array_join(shown, "\n")).select(*failures.columns, "has_line", "snippet")
