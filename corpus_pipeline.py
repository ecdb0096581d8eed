"""A training corpus from documents, in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.llm import decontamination, mixing, near_duplicates, packing, quality
from breakweave.llm.common import Scratch, held_out, read, told_apart

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; it learns from the labelled rows of the whole table."""
    model = quality.fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out(3, 1))
    return quality.score_quality(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8), that with the smallest id, null before all others.

    Rows are linked by keys of their own: the id, or a negative hash of id and text where several rows may share the id.
    Rows alike in id and text are copies. Rows without words are linked with nothing and stay.
    """
    first = F.lit(near_duplicates.FIRST)
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = told_apart(docs.where(words).select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), first).alias("id")), "id")
    rows = rows.withColumn("kept_id", F.when(F.col("tie") == 0, F.col("id")).otherwise(F.xxhash64("id", "text").bitwiseOR(first)))
    found = near_duplicates.near_duplicates(rows.select(F.col("kept_id").alias("doc_id"), "text"), shingle=5, percent=80)
    found = found.select(F.coalesce("doc_id", first).alias("kept_id"), F.coalesce("component_id", first).alias("component"))
    shared = rows.where("tie <> 0").select("kept_id", "id").distinct()
    named = found.join(shared, "kept_id", "left").select("component", F.struct(F.coalesce("id", "kept_id"), "kept_id").alias("name"))
    kept = named.groupBy("component").agg(F.min("name").alias("name")).select("name.kept_id")
    single = rows.join(kept, "kept_id").dropDuplicates(["kept_id"]).select(*COLUMNS)
    return single.unionByName(docs.where(~words).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its shards' order: a row for each time that a document is taken, whole or in part; documents of over-full sources may be left out, others come twice."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", pack_tokens),
]
#: The trained classifier and the vocabulary are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
