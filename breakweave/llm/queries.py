"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, compression, decontamination, fingerprints, licenses, manifest, mixing, near_duplicates, packing, pii, quality, substrings, toxicity
from .common import held_out, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out(5, 0))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "saving")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("spans").cast("long").alias("n_matches"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), ~held_out(3, 1))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.checked(spark, read(spark, sf_dir, "documents"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(read(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digests(spark, read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    ops = (
        op1_toxicity, op2_fingerprints, op3_licenses, op4_pii, op5_packing, op6_substring_dedup, op7_mixing, op8_decontamination, op9_near_duplicates, op10_quality,
        op11_manifest, op12_compression, op13_clustering,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": licenses.SQL, "op6_substring_dedup": substrings.SQL, "op7_mixing": mixing.SQL, "op8_decontamination": decontamination.SQL, "op9_near_duplicates": near_duplicates.SQL,
        "op11_manifest": manifest.SQL, "op13_clustering": clustering.SQL,
    }
