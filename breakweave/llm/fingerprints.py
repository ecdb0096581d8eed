"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text is taken as tokens (words, cut after 16 characters), a k-mer as K consecutive tokens, numbered by its
occurrence in the text. Each of the signature's M places draws, by a hash of its own, the minimal
occurrence-numbered k-mer of either half of the k-mers (split by one bit of that hash) and hashes the two in the
order in which the text has them. Edits that move text change that order, so the share of equal places follows edit
distance and not only the common k-mers.

Null text: as the empty one. Fewer than K tokens: one k-mer of them all; none: the empty fingerprint, which is
like itself (1) and unlike all others (0). Equal texts have equal fingerprints. Repeated doc_ids are put in order by their text's hash; null ones come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M, K = 16, 3
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
LAST = -(2**63)
POSITION_BITS = 28


def _bucket(cuts: list[int], doc_id: Column) -> Column:
    """How many cuts are above the id: looked up among every 64th cut, then among the 64 below that."""
    if not cuts:
        return F.lit(0)
    down = sorted(cuts, reverse=True)
    groups = [down[i : i + 64] for i in range(0, len(down), 64)]
    heads = F.array(*(F.lit(g[-1]) for g in groups[:-1])) if len(groups) > 1 else None
    above = F.size(F.filter(heads, lambda c: c > doc_id)) if heads is not None else F.lit(0)
    fine = F.array(*(F.array(*(F.lit(c) for c in g)) for g in groups))
    return above * 64 + F.size(F.filter(F.element_at(fine, above + 1), lambda c: c > doc_id))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, bucket, rn, ghost): every row with its successor by descending doc_id, in one shuffle of the texts.

    Buckets are ranges of doc_id between approximate quantiles, as many as a fixed multiple of the shuffle partitions. The largest id of the
    next bucket (of the first, for the last one) is in a bucket once more, as a ghost, so that the last row finds its successor too.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(partitions, min(16 * partitions, 4096))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    bucket = _bucket(cuts, F.col("doc_id"))
    tops = dict(ids.groupBy(bucket.alias("b")).agg(F.max("doc_id")).collect())
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    size = len(cuts) + 1
    top, home = (F.array(*(F.lit(x.get(b)).cast(kind) for b in range(size))) for x, kind in ((tops, "long"), (before, "int")))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    again = F.struct(F.coalesce(F.get(home, F.col("bucket")), F.lit(0)).alias("bucket"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("at", F.explode(F.when(F.get(top, F.col("bucket")) == F.col("doc_id"), F.array(own, again)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", F.col("at.bucket").alias("bucket"), F.col("at.ghost").alias("ghost"))
    # tasks of a quarter of the usual size: each text becomes about twenty times its size in k-mer rows
    rows = rows.repartition(4 * partitions, "bucket")
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc("doc_id"), F.xxhash64("text"))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def kmer_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, pos) of every k-mer of the column text."""
    parts = parts.select(*keys, F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)).alias("t"))
    many = F.transform(F.sequence(F.lit(1), F.size("t") - (K - 1)), lambda i: F.xxhash64(*(F.element_at("t", i + j) for j in range(K))))
    kmers = F.when(F.size("t") >= K, many).when(F.size("t") > 0, F.array(F.xxhash64("t"))).otherwise(F.array().cast("array<bigint>"))
    return parts.select(*keys, F.posexplode(kmers).alias("pos", "h"))


def signatures(kmers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature array<int>) by Order MinHash; nothing is shuffled if the k-mers are dealt by one of the keys."""
    items = kmers.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "h").orderBy("pos")))
    items = items.select(*keys, "pos", F.xxhash64("h", "occurrence").alias("item"))
    low = (1 << POSITION_BITS) - 1
    drawn = [F.xxhash64("item", F.lit(m)) for m in range(M)]
    items = items.select(*keys, *(d.alias(f"v{m}") for m, d in enumerate(drawn)), "pos")
    best = []
    for m in range(M):
        v = F.col(f"v{m}")
        placed = v.bitwiseAND(F.lit(~low)).bitwiseOR(F.col("pos").cast("long"))
        best += [F.min(F.when(v.bitwiseAND(F.lit(1)) == half, placed)).alias(f"m{m}_{half}") for half in (0, 1)]
    rows = items.groupBy(*keys).agg(*best)
    places = []
    for m in range(M):
        a, b = F.col(f"m{m}_0"), F.col(f"m{m}_1")
        ha, hb = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
        first = a.bitwiseAND(F.lit(low)) < b.bitwiseAND(F.lit(low))
        places.append(F.when(first | b.isNull(), F.xxhash64(ha, hb, F.lit(0))).otherwise(F.xxhash64(hb, ha, F.lit(0))))
    return rows.select(*keys, F.array(*(p.bitwiseAND(F.lit(0xFFFFFFFF)) for p in places)).alias("signature"))


def shown(signature: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits a place; empty for a text without tokens."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(M))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.expr("cast(n_chars div 3 as int)")
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.substring("next_text", F.lit(1), cut))))
    keys = ["bucket", "rn", "tag"]
    parts = rows.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("tag"), "text"), F.struct(F.lit(1).alias("tag"), F.col("edited").alias("text")))).alias("p"))
    parts = parts.select("bucket", "rn", "p.tag", "p.text").where("text is not null")
    found = signatures(kmer_rows(parts, keys), keys)
    found = found.groupBy("bucket", "rn").agg(F.max(F.when(F.col("tag") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("tag") == 1, F.col("signature"))).alias("new"))
    meta = rows.select("bucket", "rn", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    out = meta.join(found, ["bucket", "rn"], "left")
    w = Window.partitionBy("bucket").orderBy("rn")
    out = out.withColumn("after", F.lead("own").over(w)).where(~F.col("ghost"))
    return out.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
