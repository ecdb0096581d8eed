"""Mixing sources to target weights by blocks.

The words of a source, in order of doc_id, are packed into blocks of a fixed length; a source's target
is turned into slots, each of which takes one block. The slots of a source are thrown into output
shards, so that its counts over the shards are one multinomial draw with the exact total; a slot's block
is found through the source's pseudorandom permutation of block indexes, one pass over all blocks
before any block comes again, and blocks are joined to slots by index. The last slot takes only the
words still owed, so a source's taken words are its target's whole part.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share 150 % of all words;
no target exceeds twice its source, the excess is reshared by weight.

Null, empty or blank text: size 0, takes nothing. Null source: a source of its own. Repeated doc_ids:
each row counts for itself (ordered by size and text hash). An empty table gives an empty table. The table of sources, one
row each, is the only thing that is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SPAN = 1024  # doc_ids a bucket of the two-level running sum
ROUNDS = 16
ODD = "('1', '3', '5', '7', '9', 'b', 'd', 'f')"


def permuted(x: str) -> str:
    """SQL of the place that index x (0 to blocks - 1) goes to; in each round it and its mirror at the round's key may swap, as a digest of both says."""
    mirror = "pmod(keys[i] - acc, blocks)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), cast({x} as long), (acc, i) -> if(substr(md5(concat(keys[i], ':', i, ':', greatest(acc, {mirror}))), 1, 1) in {ODD}, {mirror}, acc))"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of every row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.xxhash64(text).alias("tie"),
    )


def source_targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source: size, target and how its slots are laid out."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, rank = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("weight", F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.row_number().over(rank) - 1) % 3 + 1).cast("long"))
    # sources are capped from the smallest size a weight upwards, as long as the rest's share exceeds twice their size
    before = Window.orderBy(F.expr("source_size * (10 div weight)"), F.col("source").asc_nulls_last())
    per = (
        per.withColumn("below", F.coalesce(F.sum(2 * F.col("source_size")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.expr("weight * (3 * total - 2 * below) > 4 * source_size * left"))
        .withColumn("caps", F.coalesce(F.sum(F.expr("if(capped, 2 * source_size, 0)")).over(every), F.lit(0)))
        .withColumn("free", F.sum(F.expr("if(capped, 0, weight)")).over(every))
        .withColumn("target", F.expr("if(capped, cast(2 * source_size as double), weight * (cast(3 * total - 2 * caps as double) / cast(2 * free as double)))"))
    )
    per = (
        per.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("last", F.expr(f"source_size - (blocks - 1) * {block}"))
        .withColumn("owed", F.floor("target").cast("long"))
        .withColumn("passes", F.expr("if(source_size = 0, 0, owed div source_size)"))
        .withColumn("rest", F.expr("if(source_size = 0, 0, owed % source_size)"))
        .withColumn("keys", F.expr(f"transform(sequence(0, {ROUNDS - 1}), i -> if(blocks = 0, 0L, cast(conv(substr(md5(concat(coalesce(source, ''), ':', i)), 1, 8), 16, 10) as long) % blocks))"))
        .withColumn("place", F.expr("if(blocks = 0, 0, cast(conv(substr(md5(coalesce(source, '')), 1, 8), 16, 10) as long) % blocks)"))
        .withColumn("start", F.expr(f"if(blocks = 0, 0, pmod(blocks - 1 - {permuted('place')}, blocks))"))
    )
    return (
        per.withColumn("whole", F.expr(f"case when rest <= place * {block} then rest div {block} when rest >= place * {block} + last then 1 + (rest - last) div {block} else place end"))
        .withColumn("cut", F.expr(f"case when rest <= place * {block} then rest % {block} when rest >= place * {block} + last then (rest - last) % {block} else rest - place * {block} end"))
        .withColumn("slots", F.expr("passes * blocks + whole + if(cut > 0, 1, 0)"))
    )


def draw_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = 4096, seed: int = 11, chunk: int = 65536) -> DataFrame:
    """(source, slot, pass, block, take, shard): the multinomial draw of shards and the block of every slot."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shards = F.expr(f"greatest(1, (all_slots + {shard_slots - 1}) div {shard_slots})")
    named = targets.withColumn("all_slots", F.sum("slots").over(everything)).withColumn("shards", shards).where("slots > 0")
    chunks = named.select("source", "blocks", "cut", "keys", "start", "slots", "shards", F.explode(F.expr(f"sequence(0, (slots - 1) div {chunk})")).alias("part")).repartition("source", "part")
    slots = chunks.select("*", F.explode(F.expr(f"sequence(part * {chunk}, least(slots, (part + 1) * {chunk}) - 1)")).alias("slot"))
    return slots.select(
        "source", "slot", F.expr("slot div blocks").alias("pass"), F.expr(f"({permuted('slot % blocks')} + start) % blocks").alias("block"),
        F.expr(f"if(cut > 0 and slot = slots - 1, cut, {block})").alias("take"), F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("slot")), F.col("shards")).alias("shard"),
    )


def placed(sizes: DataFrame) -> DataFrame:
    """Adds the first word's position in its source's stream, by running sums in two levels so that no source is one task."""
    spans = sizes.withColumn("span", F.expr(f"coalesce(doc_id div {SPAN}, -9223372036854775807)"))
    bases = spans.groupBy("source", "span").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("words").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "span").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    local = spans.withColumn("local", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # grows with the table, so it is never to be broadcast, however small it comes out of a shuffle
    return local.join(bases.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).withColumn("at", F.col("base") + F.col("local")).drop("s", "p", "base", "local", "span")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cuts every row into its parts of blocks: block, from and upto count words in the block; a row without words has none."""
    first = rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(at div {block}, (at + size - 1) div {block}), cast(null as array<long>))")))
    return first.withColumn("from", F.expr(f"greatest(at - block * {block}, 0)")).withColumn("upto", F.expr(f"least(at + size - block * {block}, {block})"))


def mix_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row: how many of its words the mix takes."""
    sizes = sized(docs)
    targets = source_targets(sizes, block)
    uses = draw_slots(targets, block).groupBy("source", "block").agg(F.sum(F.expr(f"if(take = {block}, 1, 0)")).alias("whole"), F.max(F.expr(f"if(take = {block}, 0, take)")).alias("cut"))
    parts = pieces(placed(sizes), block)
    uses = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "whole", "cut")
    got = parts.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").withColumn("n", F.expr("coalesce(whole * (upto - from) + greatest(0, least(upto, cut) - from), 0)"))
    rows = got.groupBy("source", "doc_id", "at", "size", "tie").agg(F.sum("n").alias("taken"), F.count(F.lit(1)).alias("parts"))
    # rows without words that are alike in all columns fell together above; each of them has one part
    rows = rows.withColumn("again", F.explode(F.expr("if(size = 0, sequence(1L, parts), array(1L))")))
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(per, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = 4096, seed: int = 11) -> DataFrame:
    """The mixed corpus itself: (doc_id, text, lang, source, n_chars, shard, slot), a row for each part of a document that a slot takes.

    text is the part's whole stretch of the document, from its first word to before the next part's.
    """
    sizes = sized(docs)
    slots = draw_slots(source_targets(sizes, block), block, shard_slots, seed)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("size", F.regexp_count("text", F.lit(WORDS)).cast("long")).withColumn("tie", F.xxhash64("text")).where("size > 0")
    at = placed(sizes.where("size > 0")).select(*(F.col(c).alias(f"p_{c}") for c in ("source", "doc_id", "size", "tie", "at"))).distinct()
    joined = rows.join(at.hint("merge"), F.col("source").eqNullSafe(F.col("p_source")) & F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("size") == F.col("p_size")) & (F.col("tie") == F.col("p_tie")))
    # rows that are alike in id, source and text take one another's places
    joined = joined.withColumn("at", F.col("p_at")).dropDuplicates(["source", "doc_id", "at", "tie"]).select("doc_id", "source", "lang", "text", "at", "size")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(r"[^ \t-\r]+")
        for pdf in batches:
            out = []
            for doc, source, lang, text, at, size in pdf.itertuples(index=False, name=None):
                starts = [m.start() for m in word.finditer(text)]
                for b in range(at // block, (at + size - 1) // block + 1):
                    lo, hi = max(0, b * block - at), min(size, (b + 1) * block - at)
                    stretch = text[0 if lo == 0 else starts[lo] : len(text) if hi == size else starts[hi]]
                    out.append((doc, source, lang, stretch, b, max(0, at - b * block), hi - lo))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=["doc_id", "source", "lang", "text", "block", "from", "n"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "source", "lang", "text", "block", "from", "n"])

    parts = joined.mapInPandas(cut, "doc_id long, source string, lang string, text string, block long, from long, n long")
    slots = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "slot", "shard", "take")
    taken = parts.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).where("take > from")
    # the last slot of a source may end inside a part
    short = F.expr(f"regexp_substr(text, concat('^[\\\\x20\\\\x09-\\\\x0D]*([^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*){{', take - from, '}}'))")
    taken = taken.withColumn("text", F.when(F.col("take") - F.col("from") < F.col("n"), short).otherwise(F.col("text")))
    return taken.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "shard", "slot")


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, text, k1, k2): k1 and k2 are 128 bits of id, source and text, by which a row is known."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    parts = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("text")]
    return rows.select("*", *(F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (1, 2)))


def runs_taken(taken: list) -> list[tuple[int, int, int, int]]:
    """(shard, slot, lo, hi) of the runs of words, in the order of the document, that neighbouring blocks of one pass make together; the first block's shard and slot stand for a run."""
    out, last = [], None
    for x in sorted(taken, key=lambda x: (x["at"], x["pass"], x["lo"])):
        if last is not None and (x["at"], x["pass"]) == last and x["lo"] == out[-1][3]:
            out[-1] = (*out[-1][:3], x["hi"])
        else:
            out.append((x["shard"], x["slot"], x["lo"], x["hi"]))
        last = (x["at"], x["pass"])
    return out


def mix_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = 4096, seed: int = 11, most: int = 4_000_000) -> DataFrame:
    """The mix as documents: (doc_id, text, lang, source, n_chars, shard, slot), a row for each pass that takes a document, or for each run of its words where a pass takes only some of its blocks.

    Rows are dealt out by shard and lie in the order of their slots. Only ids, blocks and slots are joined by block; texts are moved twice, to their runs and to their shard.
    A task hands on its rows as soon as they hold some most characters, so that it never holds more than a batch as it came and that much of the mix.
    """
    rows = named(docs)
    sizes = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size"), F.col("k1").alias("tie"), "k1", "k2")
    slots = draw_slots(source_targets(sizes, block), block, shard_slots, seed).select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "slot", "shard", "take")
    parts = pieces(placed(sizes.where("size > 0")), block)
    used = parts.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).where("take > from")
    used = used.withColumn("lo", F.expr(f"block * {block} + from - at")).withColumn("hi", F.expr("lo + least(upto, take) - from"))
    used = used.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "pass", "lo", "hi", "slot", "shard")).alias("taken"))
    # rows alike in id, source and text have one list; the first of them stands for all
    only = Window.partitionBy("k1", "k2").orderBy("k1")
    joined = rows.join(used.hint("merge"), ["k1", "k2"]).withColumn("n", F.row_number().over(only)).where("n = 1").select("doc_id", "text", "lang", "source", "taken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORDS)
        kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("shard", pa.int64()), ("slot", pa.int64())])
        out: list[dict] = []
        held = 0
        for batch in batches:
            # rows become Python values a few at a time; a batch stays in its Arrow buffers
            for first in range(0, batch.num_rows, 64):
                for row in batch.slice(first, 64).to_pylist():
                    text = row["text"]
                    starts = [m.start() for m in word.finditer(text)]
                    for shard, slot, lo, hi in runs_taken(row["taken"]):
                        stretch = text[0 if lo == 0 else starts[lo] : len(text) if hi == len(starts) else starts[hi]]
                        out.append({"doc_id": row["doc_id"], "text": stretch, "lang": row["lang"], "source": row["source"], "n_chars": len(stretch), "shard": shard, "slot": slot})
                        held += len(stretch)
                    if held > most:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    mixed = joined.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long, shard long, slot long")
    return mixed.repartition("shard").sortWithinPartitions("shard", "slot")


_ROUNDS_SQL = "\n".join(
    f"""z{i + 1} as (select source, blocks, x0, case when substr(md5(k || ':{i}:' || greatest(acc, o)), 1, 1) in {ODD} then o else acc end as acc
      from (select *, (k - acc + blocks) % blocks as o from (select *, cast(('0x' || substr(md5(coalesce(source, '') || ':{i}'), 1, 8)) as bigint) % blocks as k from z{i if i else '00'}))),"""
    for i in range(ROUNDS)
)
SQL = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
p as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast(sum(source_size) over () as bigint) as total, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from p),
c as (select *, coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as below, sum(weight) over (o rows between current row and unbounded following) as remaining
      from w window o as (order by source_size * (10 // weight), source nulls last)),
k as (select *, weight * (3 * total - 2 * below) > 4 * source_size * remaining as capped from c),
t as (select *, case when capped then cast(2 * source_size as double) else weight * (cast(3 * total - 2 * (sum(case when capped then 2 * source_size else 0 end) over ()) as double) / cast(2 * (sum(case when capped then 0 else weight end) over ()) as double)) end as target from k),
n as (select *, (source_size + {BLOCK - 1}) // {BLOCK} as blocks, source_size - ((source_size + {BLOCK - 1}) // {BLOCK} - 1) * {BLOCK} as last_len, cast(floor(target) as bigint) as owed from t),
m as (select *, case when source_size = 0 then 0 else owed // source_size end as passes, case when source_size = 0 then 0 else owed % source_size end as rest,
      case when blocks = 0 then 0 else cast(('0x' || substr(md5(coalesce(source, '')), 1, 8)) as bigint) % blocks end as place from n),
z0 as (select source, blocks, unnest(range(cast(blocks as bigint))) as x0 from m), z00 as (select *, x0 as acc from z0),
{_ROUNDS_SQL}
l as (select m.*, case when m.blocks = 0 then 0 else (m.blocks - 1 - z.acc + m.blocks) % m.blocks end as first_block,
      case when rest <= place * {BLOCK} then rest // {BLOCK} when rest >= place * {BLOCK} + last_len then 1 + (rest - last_len) // {BLOCK} else place end as whole,
      case when rest <= place * {BLOCK} then rest % {BLOCK} when rest >= place * {BLOCK} + last_len then (rest - last_len) % {BLOCK} else rest - place * {BLOCK} end as cut from m left join z{ROUNDS} z on m.source is not distinct from z.source and m.place = z.x0),
s as (select source, blocks, first_block, cut, unnest(range(cast(passes * blocks + whole + case when cut > 0 then 1 else 0 end as bigint))) as slot, passes * blocks + whole as full_slots from l),
u as (select s.source, (z.acc + first_block) % s.blocks as block, sum(case when slot < full_slots then 1 else 0 end) as uses, max(case when slot < full_slots then 0 else cut end) as part from s join z{ROUNDS} z on s.source is not distinct from z.source and s.slot % s.blocks = z.x0 group by 1, 2),
a as (select *, coalesce(sum(size) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as pos from d),
x as (select doc_id, source, pos, size, unnest(range(cast(pos // {BLOCK} as bigint), cast((pos + size - 1) // {BLOCK} + 1 as bigint))) as block from a where size > 0),
y as (select x.doc_id, sum(coalesce(uses, 0) * (least(pos + size - x.block * {BLOCK}, {BLOCK}) - greatest(pos - x.block * {BLOCK}, 0)) + greatest(0, least(pos + size - x.block * {BLOCK}, {BLOCK}, coalesce(part, 0)) - greatest(pos - x.block * {BLOCK}, 0))) as taken
      from x left join u on x.source is not distinct from u.source and x.block = u.block group by 1)
select a.doc_id, a.size, t.source_size, t.target, cast(coalesce(y.taken, 0) as bigint) as taken
from a join t on a.source is not distinct from t.source left join y on a.doc_id = y.doc_id
"""
