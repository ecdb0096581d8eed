"""A Merkle manifest: every row a leaf, every source a tree of its leaves by id, a tree over the sources' roots.

Leaves are hashed in the scan and written without texts; they are dealt into ranges of (source, id). A range knows the index of its first
leaf, and a stack of mountains (Range) takes its leaves in order: a node that fills its run of three carries upwards, so only nodes whose run lies
partly in another range stay behind, a few a level. These peaks are merged by aligned blocks, each round with larger ones, in the same stack. The last run
of a level is shorter, even one node, and is hashed as it is: nothing is padded. Nodes of every STRIDE-th level are recorded; from the root down, they tell each
block of leaves the upper part of its proofs, and the lower part is hashed again from the block's own leaves.

A digest is 64 hex characters; a node's is the SHA-256 of its children's, joined. A proof has a step a level: the digests left and right of the node in its run.
Nothing grows with a source but its number of ranges: a source of any size is many ranges and blocks.

Null values are `-`; a null source is a source of its own, before all others; null ids come first in their source and are never tampered with. Rows that share an id
are ordered by their digest; rows alike in all five columns are leaves of their own. Empty and very long texts are values like others (a text must fit a row). An empty
table has no rows and no root. Further columns are ignored. A source of one row has that row's digest as its root, and one source's root is the root of all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT, STRIDE = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
#: Rows of a range, and leaves of blocks that a task takes together.
RANGE_ROWS, BLOCK_ROWS, MOST_RANGES = 50_000, 20_000, 20_000


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def height_of(n: Column) -> Column:
    return F.array_position(F.array(*(n <= FANOUT**h for h in range(39))), True) - 1


def node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def digest(*fields: Column) -> Column:
    """A leaf's digest: each field as its length in bytes, a colon and its text, or a hyphen if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, **further: Column) -> DataFrame:
    """(doc_id, source, leaf) of every row, and further digests by name, taken in the same scan of the texts."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), digest(*(docs[c] for c in FIELDS)).alias("leaf"), *(c.alias(k) for k, c in further.items()))


class Range:
    """A stack of the runs that are not full yet, one a level, over nodes that follow each other from left to right."""

    def __init__(self, n: int):
        self.top, self.width = height(n), [n]
        for _ in range(self.top):
            self.width.append(-(-self.width[-1] // FANOUT))
        self.runs: dict[int, list[tuple[int, str]]] = defaultdict(list)
        self.peaks: list[tuple[int, int, str]] = []
        self.made: list[tuple[int, int, str]] = []

    def push(self, level: int, idx: int, value: str) -> None:
        while True:
            run = self.runs[level]
            run.append((idx, value))
            if level == self.top or (idx % FANOUT < FANOUT - 1 and idx + 1 < self.width[level]):
                return
            if len(run) <= idx % FANOUT:  # the run began in another range: its end waits for the merge
                self._leave(level)
                return
            value = node([v for _, v in run])
            run.clear()
            level, idx = level + 1, idx // FANOUT
            if level % STRIDE == 0:
                self.made.append((level, idx, value))

    def _leave(self, level: int) -> None:
        self.peaks += [(level, i, v) for i, v in self.runs.pop(level, [])]

    def close(self) -> list[tuple[int, int, str]]:
        """All nodes without a parent here."""
        for level in list(self.runs):
            self._leave(level)
        return self.peaks


NODES = "grp string, n long, level int, idx long, value string, peak boolean"


def _grown(rows: Iterator[tuple[str, int, int, int, str]]) -> pd.DataFrame:
    """The peaks and recorded nodes over rows of (grp, n, level, idx, value), those of a group from left to right."""
    out, stack, current = [], None, None

    def close() -> None:
        if stack is not None:
            out.extend((*current, *x, False) for x in stack.made)
            out.extend((*current, *x, True) for x in stack.close())

    for grp, n, level, idx, value in rows:
        if (grp, n) != current:
            close()
            stack, current = Range(n), (grp, n)
        stack.push(level, idx, value)
    close()
    return pd.DataFrame(out, columns=["grp", "n", "level", "idx", "value", "peak"])


def grow_range(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["grp", "idx"])
    return _grown((g, n, 0, i, v) for g, n, i, v in zip(pdf["grp"], pdf["n"], pdf["idx"], pdf["leaf"]))


def merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's peaks under one node: those that the block holds whole become it."""
    rows = sorted(zip(pdf["idx"] * FANOUT ** pdf["level"], pdf["level"], pdf["idx"], pdf["value"]))
    grp, n = pdf["grp"].iloc[0], pdf["n"].iloc[0]
    return _grown((grp, n, level, i, v) for _, level, i, v in rows)


class Tree:
    """One tree for each group: rows with their index, recorded nodes, and roots."""

    def __init__(self, indexed: DataFrame, nodes: list[DataFrame], roots: DataFrame, levels: int, rows: int):
        self.indexed, self.nodes, self.roots, self.levels, self.rows = indexed, nodes, roots, levels, rows


def tree(rows: DataFrame, order: tuple[str, ...], scratch: Scratch, range_rows: int = RANGE_ROWS) -> Tree | None:
    """The trees over rows of (grp, leaf, ...), whose leaves ascend by order within a group; None without rows. rows must be a written table."""
    total = rows.count()
    if not total:
        return None
    ranges = min(-(-total // range_rows), MOST_RANGES)
    keys = ["grp", *(F.col(c).asc_nulls_first() for c in order), "alike"]
    # rows alike in all else must not be one range
    dealt = rows.withColumn("alike", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("alike")
    dealt = scratch.save(dealt.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges")
    runs = dealt.groupBy("range", "grp").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    by = Window.partitionBy("grp")
    before = F.coalesce(F.sum("size").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("range", "grp", "first", before.alias("before"), F.sum("size").over(by).alias("n"))
    indexed = scratch.save(dealt.join(runs, ["range", "grp"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before"), "indexed")
    top = height(indexed.agg(F.max("n")).first()[0])
    grown = scratch.save(indexed.select("range", "grp", "n", "idx", "leaf").groupBy("range").applyInPandas(grow_range, NODES), "mountains")
    done, level = [grown], min(top, height(-(-total // ranges)) + STRIDE // 2)
    rest = grown.where(F.col("peak") & (F.col("level") < height_of(F.col("n"))))
    while not rest.isEmpty():
        block = F.floor(F.col("idx") / F.pow(F.lit(FANOUT), F.greatest(F.lit(level) - F.col("level"), F.lit(0)).cast("double"))).cast("long")
        grown = scratch.save(rest.groupBy("grp", block.alias("block")).applyInPandas(merge_block, NODES), f"merged{level}")
        done.append(grown)
        rest, level = grown.where(F.col("peak") & (F.col("level") < height_of(F.col("n")))), min(top, level + STRIDE)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    # written, since it meets nodes of the same tables below
    roots = scratch.save(every.where(F.col("peak") & (F.col("level") == height_of(F.col("n")))).select("grp", "n", F.col("value").alias("top")), "roots")
    nodes = [every.where(~F.col("peak") & (F.col("level") == k) & (F.col("level") < height_of(F.col("n")))).select("grp", "n", "idx", F.col("value").alias("leaf")) for k in range(STRIDE, top, STRIDE)]
    return Tree(indexed, nodes, roots, top, total)


def proofs_of_block(values: list[str], levels: int) -> list[list[dict]]:
    """Proofs of all nodes of a block, up to the one node that is over them, some levels above."""
    steps = []
    for _ in range(levels):
        steps.append([{"left": "".join(values[i - i % FANOUT : i]), "right": "".join(values[i + 1 : i - i % FANOUT + FANOUT])} for i in range(len(values))])
        values = [node(values[i : i + FANOUT]) for i in range(0, len(values), FANOUT)]
    return [[step[i // FANOUT**k] for k, step in enumerate(steps)] for i in range(len(steps[0]))] if steps else [[] for _ in values]


def proved(rows: DataFrame, above: DataFrame, below: int, size: int, keep: tuple[str, ...]) -> DataFrame:
    """rows of (grp, n, idx, leaf, keep), which are nodes of level below, with proof: in their block, then as the node over the block, of which above has (grp, block, proof)."""
    names = ["grp", "n", "idx", *keep]
    left = rows.withColumn("block", F.floor(F.col("idx") / FANOUT**STRIDE).cast("long"))
    blocks = max(1, -(-size // BLOCK_ROWS))
    key = F.pmod(F.xxhash64("grp", "block"), F.lit(blocks)).alias("key")

    def run(mine: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        upper = {(g, b): p for g, b, p in zip(over["grp"], over["block"], over["proof"])}
        mine = mine.sort_values(["grp", "idx"])
        proofs: list[list] = []
        rows = zip(mine["grp"], mine["block"], mine["n"], mine["leaf"])
        for (grp, block, n), part in groupby(rows, itemgetter(0, 1, 2)):
            rest = [{"left": s["left"], "right": s["right"]} for s in upper[grp, block]]
            proofs += [p + rest for p in proofs_of_block([r[3] for r in part], min(STRIDE, height(n) - below))]
        out = mine[names].copy()
        out["proof"] = proofs
        return out

    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in left.schema.fields)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + f", proof {PROOF}"
    right = above.select("grp", "block", "proof")
    return left.select("*", key).groupBy("key").cogroup(right.select("*", key).groupBy("key")).applyInPandas(run, schema)


def with_proofs(built: Tree, above: DataFrame | None, scratch: Scratch, keep: tuple[str, ...]) -> DataFrame:
    """The leaves of the trees with the columns keep and their proofs; above: (grp, proof), how each root goes on, if it does."""
    tops = built.roots.select("grp", "n", F.array().cast(PROOF).alias("proof")) if above is None else built.roots.select("grp", "n").join(above.select("grp", "proof"), "grp")
    tops = tops.withColumn("height", height_of(F.col("n"))).withColumn("block", F.lit(0).cast("long"))
    over = None
    for k in range(len(built.nodes), -1, -1):
        below = k * STRIDE
        low = F.col("height") > below if k else F.lit(True)
        here = tops.where(low & (F.col("height") <= below + STRIDE)).select("grp", "block", "proof")
        over = here if over is None else over.select("grp", F.col("idx").alias("block"), "proof").unionByName(here)
        rows = built.nodes[k - 1] if k else built.indexed.select("grp", "n", "idx", "leaf", *(c for c in keep if c != "leaf"))
        over = proved(rows, over, below, -(-built.rows // FANOUT**below), keep if k == 0 else ())
        if k:
            over = scratch.save(over, f"proofs{below}")
    return over.drop("n", "idx")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, joined, level by level."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(spark: SparkSession, docs: DataFrame, range_rows: int = RANGE_ROWS, **further: Column) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, and further digests) of every row of docs."""
    scratch = Scratch(spark, "manifest")
    group = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    # ids pass through tasks as text: pandas would round large ones beside nulls
    rows = scratch.save(leaves(docs, **further).select("*", F.col("doc_id").cast("string").alias("name"), group.alias("grp")), "leaves")
    keep = ("name", "source", "leaf", *further)
    trees = tree(rows, ("doc_id", "leaf"), scratch, range_rows)
    if trees is None:
        return rows.select("doc_id", *keep[1:], F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PROOF).alias("proof"))
    tops = scratch.save(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("leaf")), "subroots")
    over = tree(tops, ("name",), scratch, range_rows)
    root = over.roots.first()["top"]
    named = scratch.save(with_proofs(over, None, scratch, ("name", "leaf")).select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "proof"), "sources")
    out = with_proofs(trees, named, scratch, keep)
    # a leaf and the part of its proof below the subroot give the subroot: the steps above are as many as the source's own proof has
    levels = F.size("proof") - over.levels
    return out.select(F.col("name").cast("long").alias("doc_id"), *keep[1:], folded(F.col("leaf"), F.slice("proof", F.lit(1), levels)).alias("subroot"), F.lit(root).alias("root"), "proof")


def tampered(docs: DataFrame) -> Column:
    """The digest of a row after tampering: without its line ends where the CRC of its id is even."""
    even = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace(docs["text"].cast("string"), F.lit("\n"), F.lit(""))).otherwise(docs["text"].cast("string"))
    return digest(*(text if c == "text" else docs[c] for c in FIELDS))


def checked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of docs, and tampered rows held against it."""
    rows = manifest(spark, docs, shown=tampered(docs)).withColumn("folded_root", folded(F.col("shown"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: One tree's nodes, then how each leaf's digest meets its siblings, level by level.
_TREE = """{t}_node as (
 select grp, 0 as level, idx, n, digest from {t}_leaf
 union all
 select grp, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by idx)) from {t}_node where n > 1 group by grp, level, idx // 3, n
), {t}_step as (
 select a.grp, a.level, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx < a.idx), '') as l, coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx > a.idx), '') as r
 from {t}_node a join {t}_node b on a.grp = b.grp and a.level = b.level and a.idx // 3 = b.idx // 3 where a.n > 1 group by a.grp, a.level, a.idx
)"""
_FIELD = "coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"


def _digest_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=text if c == "text" else c) for c in FIELDS) + ")"


#: Every tree level by level; the CRC is taken bit by bit.
SQL = f"""with recursive raw as (
 select *, {_digest_sql("text")} as digest, {_digest_sql("bare")} as cut, coalesce('1' || source, '0') as grp from (select *, replace(text, chr(10), '') as bare,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) as crc from documents)
), d_leaf as (
 select *, row_number() over (partition by grp order by doc_id nulls first, digest) - 1 as idx, count(*) over (partition by grp) as n from raw
), {_TREE.format(t="d")}, s_leaf as (
 select '' as grp, grp as name, digest, row_number() over (order by grp) - 1 as idx, count(*) over () as n from d_node where n = 1
), {_TREE.format(t="s")}, fold as (
 select doc_id, digest as leaf, grp, idx, 0 as level, n, case when crc % 2 = 0 then cut else digest end as acc, '' as proof from d_leaf
 union all
 select f.doc_id, f.leaf, f.grp, f.idx // 3, f.level + 1, (f.n + 2) // 3, sha256(s.l || f.acc || s.r), f.proof || s.l || s.r from fold f join d_step s on s.grp = f.grp and s.level = f.level and s.idx = f.idx where f.n > 1
), onward as (
 select f.doc_id, f.leaf, s.digest as subroot, s.idx, 0 as level, s.n, f.acc, f.proof from fold f join s_leaf s on s.name = f.grp where f.n = 1
 union all
 select o.doc_id, o.leaf, o.subroot, o.idx // 3, o.level + 1, (o.n + 2) // 3, sha256(s.l || o.acc || s.r), o.proof || s.l || s.r from onward o join s_step s on s.level = o.level and s.idx = o.idx where o.n > 1
)
select o.doc_id, o.leaf, o.subroot, t.digest as root, sha256(o.proof) as proof_sha256, o.acc as folded_root, o.acc = t.digest as verified from onward o, (select digest from s_node where n = 1) t where o.n = 1"""
