"""Near duplicates by a chosen-path set similarity join.

A document's set of word shingles is drawn as a fixed number of minwise tokens. A tree branches documents
by a chosen token, and nodes that are still large by further tokens chosen for the node; small nodes
are compared exhaustively, and independent trees are repeated until a pair at the threshold is
missed with a probability below 1e-6 (0.2 to the 10th at 0.8, before the further levels). A node that tokens can't split, as
a large group of copies, is dealt into blocks by three more tokens; its smallest member is in all of them. Where that leaves such a node
with more than one component, the members outside its largest one are compared with all of the node, a task for each pair of parts.

In a node, pairs are first compared by their tokens (under half of them equal: no link), then links are
confirmed on full sets, best first, until the node's members are known to be one group. Equal sets are one member throughout.

Null or blank text: the empty set, linked with nothing. Fewer words than a shingle: the whole sequence is
one shingle. Repeated texts: one component. Rows that share a doc_id share a component; null ids are one id, before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, texts
from .components import components

TOKENS = 48
ROUNDS = ((0, 1, 2), (3, 4, 5, 6, 7, 8, 9))
FIRST = -(2**63)
#: Rows of three longs that are sent to every task rather than shuffling the texts to them: 24 MB at most.
SENT = 1_000_000
_rng = np.random.default_rng(5)
FACTORS = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)


def shingle_sets(parts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of n words, A-Z lower-cased."""
    raw, starts, ends, first = W.tokenise(parts, lower=True)
    h = W.hashes(raw, starts, ends)
    grams, out = W.windows(h, n), []
    for i in range(len(parts)):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(W.windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    x = W.mix(s + np.uint64(len(s)))
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(W.mix(x + np.uint64(77)).sum(dtype=np.uint64).view(np.int64))


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, tokens) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for at, parts in W.chunks(rows):
                sets = shingle_sets(parts, n)
                sizes = np.array([len(s) for s in sets])
                tokens = np.zeros((len(sets), TOKENS), dtype=np.int64)
                some = np.flatnonzero(sizes)
                if len(some):
                    flat, begin = np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    for t in range(TOKENS):
                        tokens[some, t] = np.minimum.reduceat(W.mix(flat * FACTORS[t] + SHIFTS[t]) >> np.uint64(33), begin).astype(np.int64)
                keys = [set_key(s) if len(s) else (0, 0) for s in sets]
                yield pd.DataFrame({"doc_id": ids[at : at + len(sets)], "n_shingles": sizes, "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "tokens": list(tokens.astype(np.int32))})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<int>")


def _node(*parts) -> F.Column:
    return F.xxhash64(*parts)


def tree_nodes(members: DataFrame, trees: tuple[int, ...], small: int, scratch: Scratch, levels: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of the nodes with two members or more; a node has some small members at most. Second, if there are any, those that stay larger, whole.

    Only ids and nodes are shuffled while nodes are counted; tokens are fetched for the members of large nodes alone.
    """
    token = lambda at: F.get(F.col("tokens"), at.cast("int"))
    tokens = members.select("rep", "tokens")
    rows = members.select("rep", F.explode(F.array(*(_node(F.lit(t), token(F.lit(t))) for t in trees))).alias("node"))
    parts, large = [], None
    for level in range(1, levels + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("least")).where("m > 1")
        rows = scratch.save(rows.join(sizes, "node"), f"level{level}")
        parts.append(rows.where(F.col("m") <= small).select("node", "rep"))
        large = rows.where(F.col("m") > small)
        if large.isEmpty():
            large = None
            break
        if level < levels:
            # one further token, for every fourth node two: 1 / threshold on average
            picks = F.when(F.pmod(_node("node", F.lit(level)), F.lit(4)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            rows = large.select("node", "rep", F.explode(picks).alias("k")).join(tokens, "rep").withColumn("at", F.pmod(_node("node", "k"), F.lit(TOKENS)))
            rows = rows.select("rep", _node("node", "at", token(F.col("at"))).alias("node"))
    if large is not None:
        at = [token(F.pmod(_node("node", F.lit(f"block{i}")), F.lit(TOKENS))) for i in range(3)]
        blocks = large.join(tokens, "rep").select("node", "rep", "least", F.pmod(_node("node", *at), F.ceil(F.col("m") / (small // 2)).cast("long")).alias("block"))
        sizes = blocks.groupBy("node", "block").agg(F.count(F.lit(1)).alias("k"))
        blocks = blocks.join(sizes, ["node", "block"]).withColumn("part", F.pmod(_node("node", "rep"), F.ceil(F.col("k") / small).cast("long")))
        blocks = scratch.save(blocks.select(_node("node", "block", "part").alias("node"), "rep", "least"), "blocks")
        parts += [blocks.where("rep <> least").select("node", "rep"), blocks.select("node", F.col("least").alias("rep")).distinct()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return scratch.save(out, "nodes"), None if large is None else large.select("node", "rep")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label, the component of rep so far."""
    return rows.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def crossed(stuck: DataFrame, labels: DataFrame, small: int, scratch: Scratch) -> DataFrame | None:
    """(node, rep) in which every member outside its large node's largest component meets every member of the node; None if all are one component."""
    rows = labelled(stuck, labels)
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("node").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")).where("m > most")
    sizes = scratch.save(sizes, "split")
    if sizes.isEmpty():
        return None
    part = lambda n: F.ceil(n / (2 * small)).cast("long")
    rows = rows.join(sizes, "node").select("node", "rep", F.expr("label <> main").alias("outside"), part(F.col("m") - F.col("most")).alias("parts"), part(F.col("m")).alias("all_parts"))
    mine = lambda n: F.pmod(F.xxhash64("rep", "node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = rows.where("outside").select("node", "rep", mine("parts").alias("p"), upto("all_parts").alias("q"))
    other = rows.select("node", "rep", upto("parts").alias("p"), mine("all_parts").alias("q"))
    return scratch.save(one.unionByName(other).select(_node("node", "p", "q").alias("node"), "rep"), "crossed")


def still_open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(group_id, rep, label) of the groups that hold more than one component so far."""
    now = labelled(groups, labels)
    return now.join(now.groupBy("group_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("group_id"), "group_id")


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """Adds bucket, by which some each rows (of whole keys) are handed to a task at a time; single keys are small."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(rows.count() // each + 1)))


def alike(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, rep): the parts of each node whose members' tokens agree in half or more; the same members only once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "rep"]).sort_values(["node", "rep"])
        node, ids, sigs = pdf["node"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64), np.stack(pdf["tokens"].to_numpy())
        begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        group, rep = [], []
        for lo, hi in zip(begins, np.append(begins[1:], len(node)), strict=True):
            sig, label = sigs[lo:hi], np.full(hi - lo, -1)
            for i in range(hi - lo):
                if label[i] >= 0:
                    continue
                label[i], stack = i, [i]
                while stack:
                    near = np.flatnonzero((label < 0) & (2 * (sig == sig[stack.pop()]).sum(1) >= TOKENS))
                    label[near] = i
                    stack.extend(near.tolist())
                mine = ids[lo:hi][label == i]
                if len(mine) > 1:
                    g = W.mix(W.mix(mine.view(np.uint64)) + np.arange(len(mine), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    group += [int(g.view(np.int64))] * len(mine)
                    rep += mine.tolist()
        return pd.DataFrame({"group_id": np.array(group, dtype=np.int64), "rep": np.array(rep, dtype=np.int64)})

    rows = dealt(nodes, "node", 4000).join(members.select("rep", "tokens"), "rep")
    return rows.groupBy("bucket").applyInPandas(run, "group_id long, rep long").distinct()


def spanning_links(ids: list[int], arrays: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Confirmed links that span what is linked among the sets; pairs known to be connected, as by equal labels, are not compared."""
    size, top, found = np.array([len(s) for s in arrays]), np.array(labels or ids), []
    begin, marks = np.concatenate([[0], np.cumsum(size)]), np.zeros(1 << 20, np.uint8)
    slot = (np.concatenate(arrays) >> np.uint64(44)).astype(np.int32) if len(ids) else None
    for i in range(1, len(ids)):
        small, large = np.minimum(size[:i], size[i]), np.maximum(size[:i], size[i])
        near = np.flatnonzero((top[:i] != top[i]) & (100 * small >= percent * large))
        if len(near) > 16:  # an upper bound of what each has in common with this one
            marks[slot[begin[i] : begin[i + 1]]] = 1
            most = np.add.reduceat(marks[slot[: begin[i]]], begin[:i], dtype=np.int64)[near]
            marks[slot[begin[i] : begin[i + 1]]] = 0
            near = near[100 * most >= percent * (size[i] + size[near] - most)]
        for j in near.tolist():
            if top[j] == top[i]:
                continue
            a, b = (arrays[i], arrays[j]) if size[i] <= size[j] else (arrays[j], arrays[i])
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * common >= percent * (size[i] + size[j] - common):
                found.append((ids[j], ids[i]))
                top[top == top[i]] = top[j]
        if (top == top[0]).all():
            break
    return found


def links(groups: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links on full sets that span each group's linked members. groups: group_id, rep, label; held: rep, text, k1, k2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        pdf = pdf.sort_values(["group_id", "rep"], ignore_index=True)
        group, reps, keys, rows = pdf["group_id"].to_numpy(), pdf["rep"].tolist(), list(zip(pdf["k1"], pdf["k2"], strict=True)), pdf["text"].tolist()
        label = dict(zip(reps, pdf["label"].tolist(), strict=True))
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for lo, hi in zip(begins, np.append(begins[1:], len(group)), strict=True):
            sets: dict[int, np.ndarray] = {}
            for at, parts in W.chunks(rows[lo:hi]):
                for i, s in enumerate(shingle_sets(parts, n), lo + at):
                    if set_key(s) == keys[i]:
                        sets[reps[i]] = s
            found += spanning_links(list(sets), list(sets.values()), percent, [label[x] for x in sets])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt(groups, "group_id", 500).join(held, "rep").groupBy("bucket").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, small: int = 400) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: the smallest doc_id that links reach, and whether it is the row's own."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(FIRST)))
    known = scratch.save(described(rows, shingle), "described")
    members = known.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("tokens", "doc_id").alias("tokens"))
    members = scratch.save(members, "members")
    trees = [tree_nodes(members, chosen, small, scratch) for chosen in ROUNDS]
    rounds = [scratch.save(alike(nodes, members), f"groups{i}") for i, (nodes, _) in enumerate(trees)]

    def fetched(groups: DataFrame, name: str) -> DataFrame:
        wanted = scratch.save(groups.select("rep").distinct().join(members.select("rep", "k1", "k2"), "rep"), f"{name}_wanted")
        side = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        return scratch.save(rows.join(side, rows["doc_id"] == wanted["rep"]).select("rep", "text", "k1", "k2"), name)

    held = fetched(rounds[0].select("rep").unionByName(rounds[1].select("rep")), "held")
    first = scratch.save(links(rounds[0].withColumn("label", F.col("rep")), held, shingle, percent), "links0")
    labels = components(first, scratch)

    def joined(found: DataFrame, labels: DataFrame) -> DataFrame:
        more = found.unionByName(labels.select(F.col("label").alias("a"), F.col("id").alias("b")))
        return components(more, scratch) if not found.isEmpty() else labels

    # groups that the first trees have made one component need no more comparing
    second = scratch.save(links(scratch.save(still_open(rounds[1], labels), "open"), held, shingle, percent), "links1")
    labels = joined(second, labels)
    # large nodes of the first trees, then of the others: what is linked by then needn't be compared
    for i, (_, stuck) in enumerate(trees):
        nodes = crossed(stuck, labels, small, scratch) if stuck is not None else None
        if nodes is not None:
            groups = scratch.save(still_open(scratch.save(alike(nodes, members), f"crossed_groups{i}"), labels), "open")
            third = scratch.save(links(groups, fetched(groups, "held"), shingle, percent), f"crossed_links{i}")
            labels = joined(third, labels)
    tops = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("label", "rep").alias("top"))
    out = known.select("doc_id", "n_shingles", "k1", "k2").join(tops, ["k1", "k2", "n_shingles"], "left").withColumn("top", F.coalesce("top", "doc_id"))
    back = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), "n_shingles", back("top").alias("component_id"), (F.col("doc_id") == F.col("top")).alias("kept"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 80 * (x.n + y.n - common)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as reached from w union select r.doc_id, l.b from r join l on r.reached = l.a),
c as (select doc_id, min(reached) as component_id from r group by 1)
select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on c.doc_id = n.doc_id
"""
