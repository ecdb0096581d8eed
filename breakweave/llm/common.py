"""Reading, scratch tables and labelled samples shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 65536


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text) of a table, and the columns named in keep; others, whatever their names, are left out; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *keep)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='breakweave-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def told_apart(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds tie: with the id, which is never null, it names a row by its text where several rows may share the id, and is 0 elsewhere.

    Ids that recur mark one of BUCKETS; the table of marks is bounded, so it may be broadcast. A mark that other ids share only makes
    their ties longer. Rows alike in id and text keep one name.
    """
    bucket = F.pmod(F.xxhash64(id_col), F.lit(BUCKETS))
    marks = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(bucket.alias("mark")).distinct()
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(marks), F.col("bucket") == F.col("mark"), "left")
    return marked.select(*rows.columns, F.when(F.col("mark").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long").alias("tie"))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, per_class: int, max_bytes: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, y), and the columns of docs named in keep, of at most per_class rows of either label, those with the lowest hash of the id, as far as max_bytes of their whole texts go.

    Texts of more than a twentieth of max_bytes come after all others of their label, so that a few of them never crowd the others out, and a label's first row always stays. So a label that has rows with a text keeps some, whatever their sizes.

    The choice is made on labels alone, which has no texts, so that only the chosen texts are fetched.
    The bound is per_class, so the broadcast of the chosen ids is bounded too. Ids that recur count once.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = texts(docs, *keep).join(F.broadcast(chosen), "doc_id")
    size = F.octet_length("text")
    order = (size > max_bytes // 20, F.xxhash64("doc_id"), "doc_id", F.length("text"), F.xxhash64("text"))
    by = Window.partitionBy("y").orderBy(*order)
    rows = rows.withColumn("upto", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(by))
    return rows.where((F.col("upto") <= max_bytes) | (F.col("nth") == 1)).drop("upto", "nth")
