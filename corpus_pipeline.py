"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, whatever further ones a table has. An empty table gives an empty one. Repeated
rows, and rows without an id, are documents like others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm import line_templates, minhash, packing, pii, quality_rules
from tallyridge.llm.common import Scratch, discarding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those without a word (null and empty texts), and by shares of symbols, capitals and repeats.

    Shortness alone is no reason here: most of the short documents are labelled good.
    """
    return quality_rules.keep(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), min_words=1)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document left without a word (null and empty texts too) goes as well.

    Rows of one id, and those without an id, are one document here: what recurs among them alone stays.
    """
    left = line_templates.dedup(spark, docs)
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles, stays.

    Null and empty texts are in no group, nor are rows without an id; rows that repeat an id stay or go together.
    """
    gone = minhash.near_duplicates(spark, docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(spark, docs).withColumn("n_chars", F.length("text").cast("long"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a token window; a null or empty text is the one id that ends it."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("windows", windows)]
#: SQL cannot express tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with discarding():  # what a stage has stored for itself goes with its end
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
