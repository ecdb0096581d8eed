"""Which reader owns a log, and what the others add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, quoted
from .echoes import FACTS, bare, base, said
from .parsing import named
from .readers import READERS, Reader

#: Pairs of own and other failures up to which a log may well be compared within its row.
PAIRS = 1 << 16


def hinted(logs: DataFrame, readers: tuple[Reader, ...] = READERS) -> DataFrame:
    """(log_id, reader, hint): the position in argv of a word that names the reader's command; python -m X counts as X."""
    words = logs.where(F.size("argv") > 0).select("log_id", F.posexplode("argv").alias("hint", "word")).withColumn("word", F.element_at(F.split("word", "/"), -1))
    names = F.create_map(*(F.lit(x) for w in sorted({c for r in readers for c in r.commands}) for x in (w, ",".join(str(i) for i, r in enumerate(readers) if w in r.commands))))
    return words.select("log_id", "hint", F.explode(F.split(names[F.col("word")], ",")).alias("r")).groupBy("log_id", F.col("r").cast("int").alias("reader")).agg(F.min("hint").alias("hint"))


def winners(failures: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Adds role: own for the failures of the log's first reader in order (hinted ones before), other for the rest."""
    rows = failures.withColumn("hint", F.lit(None).cast("int"))
    if hints is not None:
        # a row a log, joined by log alone, as the failures are dealt
        by = hints.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("reader", "hint"))).alias("by_reader"))
        rows = failures.join(by, "log_id", "left").withColumn("hint", F.col("by_reader")[F.col("reader")]).drop("by_reader")
    # that a build step failed is how the failure showed, not why: whatever else was read comes before it, but for guesses
    late = F.when((F.col("reader_name") == "docker") & F.col("message").startswith("failed to solve: process "), 1).when(F.col("reader_name") == "generic", 2).otherwise(0)
    rank = F.struct(late.alias("late"), F.coalesce("hint", F.lit(1 << 20)).alias("h"), F.col("reader").alias("r"))
    # failures are dealt by log already, so this shuffles nothing and reads no log twice
    first = F.min(rank).over(Window.partitionBy("log_id"))
    return rows.withColumn("first", first).withColumn("role", F.when(F.col("reader") == F.col("first.r"), "own").otherwise("other")).drop("first", "hint")


def hints(readers: tuple[Reader, ...]) -> str:
    """An array of (reader, hint) of argv, the first word that names a reader's command first, as SQL; see hinted."""
    names = ", ".join(f"{quoted(w)}, {quoted(','.join(str(i) for i, r in enumerate(readers) if w in r.commands))}" for w in sorted({c for r in readers for c in r.commands}))
    if not names:
        return "array()"
    found = f"split(get(map({names}), element_at(split(w, '/'), -1)), ',')".replace("get(map(", "try_element_at(map(")
    return f"coalesce(flatten(transform(argv, (w, i) -> transform(coalesce({found}, array()), r -> named_struct('reader', cast(r as int), 'hint', i)))), array())"


def first(readers: tuple[Reader, ...], sources: tuple, hinted: bool) -> str:
    """The reader that owns a log (null without failures), by its column said and, with hints, argv; as winners, as SQL."""
    at = {r.name: i for i, r in enumerate(readers)}
    late = f"case when r.reader = {at.get('docker', 'null')} and startswith(r.message, 'failed to solve: process ') then 1 when r.reader = {at.get('generic', 'null')} then 2 else 0 end"
    hint = f"coalesce(get(filter(hs, h -> h.reader = r.reader), 0).hint, {1 << 20})" if hinted else "0"
    least = f"array_min(transform(said, r -> named_struct('late', {late}, 'h', {hint}, 'r', r.reader))).r"
    return let("hs", hints(readers), least) if hinted else least


def added(rows: DataFrame, readers: tuple[Reader, ...], sources: tuple = ()) -> DataFrame:
    """rows (log_id, said, first) with more, the failures that other readers add, each once; as secondaries, within a log's row."""
    name = named(lambda *x: x[0], readers, sources, "f.reader")
    anchored = f"f.reader <> first and {name} <> 'generic' and (f.file is not null or f.code is not null or f.subject is not null or f.label is not null)"
    rows = rows.withColumn("more", F.expr(f"filter(said, f -> {anchored})"))
    own = F.expr("filter(said, f -> f.reader = first)")
    new = F.filter("more", lambda r: ~F.exists("mine", lambda m: _said(r, m)))
    rows = rows.withColumn("mine", F.when(F.size("more") > 0, own)).withColumn("more", F.when(F.size("more") > 0, new).otherwise(F.col("more"))).drop("mine")
    key = ("file", "line", "col", "message")
    ordered = f"sort_array(transform(more, f -> named_struct({', '.join(f"'{k}', f.{k}" for k in key)}, 'reader', f.reader, 'ord', f.ord, 'f', f)))"
    same = " and ".join(f"get(ks, i).{k} <=> get(ks, i - 1).{k}" for k in key)
    once = let("ks", ordered, f"transform(filter(ks, (x, i) -> i = 0 or not ({same})), x -> x.f)")
    return rows.withColumn("more", F.expr(f"if(size(more) > 1, {once}, more)"))


def _said(r: Column, m: Column) -> Column:
    """Whether the own failure m says what r of another tool says."""
    either = lambda a, b, test: test(a, b) | test(b, a)
    free = lambda a, b: a.isNull() | b.isNull() | (a == b)
    # what costs least comes first, since most pairs differ in it
    place = r["line"].eqNullSafe(m["line"]) & either(r["file"], m["file"], F.endswith) & (base(r["file"]) == base(m["file"])) & free(r["col"], m["col"]) & free(r["code"], m["code"])
    located = place & ((bare(r["message"]) == bare(m["message"])) | ((r["title"] == m["title"]) & either(r["message"], m["message"], F.startswith)))
    overlap = F.exists(r["places"], lambda p: F.exists(m["places"], lambda q: (p["start"] <= q["end"]) & (q["start"] <= p["end"])))
    same_text = ((r["message"] == m["message"]) | ((F.length(r["message"]) >= 4) & either(m["message"], r["message"], F.contains))) & overlap
    echo = r["file"].isNull() & m["file"].isNotNull() & (F.length(r["message"]) >= 4) & F.contains(m["message"], r["message"])
    return F.coalesce(located, F.lit(False)) | F.coalesce(same_text, F.lit(False)) | F.coalesce(echo, F.lit(False))


def secondaries(ranked: DataFrame, pairs: int | None = None) -> DataFrame:
    """The failures that other readers add: anchored, and not what the log's own reader said about the same place or in the same lines.

    Located: same file and line, no differing column or code, and the same message (a bracketed code or full stop at its end aside), or one title and one message
    the other's beginning. By text: the same message, or one that holds the other, in overlapping lines. Echo: a failure without place whose message a located one holds.
    The failures of a log meet in one row, which is smaller than the log was, and are compared there. Given pairs (PAIRS fits), only logs of up to so many are; those of
    other logs are compared by keys and sorted intervals (see echoes), with the same result. That reads ranked several times, so it should be a written table.
    """
    shown = [c for c in ranked.columns if c not in ("log_id", "role")]
    anchored = "role = 'other' and reader_name <> 'generic' and (file is not null or code is not null or subject is not null or label is not null)"
    mine = F.when(F.col("role") == "own", F.struct(*FACTS))
    by = ranked.where(f"role = 'own' or ({anchored})").groupBy("log_id").agg(F.collect_list(mine).alias("mine"), F.collect_list(F.when(F.expr(anchored), F.struct(*shown))).alias("rest"))
    by = by.where(F.size("rest") > 0)
    product = F.size("mine").cast("long") * F.size("rest")
    few = by if pairs is None else by.where(product <= pairs)
    left = few.select("log_id", F.inline(F.filter("rest", lambda r: ~F.exists("mine", lambda m: _said(r, m)))))
    if pairs is not None:
        many = by.where(product > pairs)
        rest = many.select("log_id", F.inline("rest")).withColumn("key", F.sha2(F.to_json(F.struct(*FACTS)), 256))
        heard = said(rest.select("log_id", "key", *FACTS).distinct(), many.select("log_id", F.inline("mine")))
        left = left.unionByName(rest.join(heard, ["log_id", "key"], "left_anti").drop("key"))
    left = left.withColumn("role", F.lit("other"))
    w = Window.partitionBy("log_id", "file", "line", "col", "message").orderBy("reader", "ord")
    return left.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").select(*ranked.columns)
