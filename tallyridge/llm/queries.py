"""One registered query per operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyridge.llm import bpe, itq, langid, line_templates, minhash, packing, pii, quality_model, quality_rules, records, runs, vantage, whitening
from tallyridge.llm.common import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digests(spark, documents(spark, sf_dir))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(spark, documents(spark, sf_dir))


def op4_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, documents(spark, sf_dir), shingle=2)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digests(spark, documents(spark, sf_dir), Scratch(spark).path("records"))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(spark, documents(spark, sf_dir))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.held_out_scores(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(documents(spark, sf_dir))


def op12_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_line_templates, op3_skip_chain_pii, op4_signature_join, op5_token_records, op6_risk_controlled_rules, op7_dp_packing, op8_cross_parsing, op9_random_indexing, op10_iterative_quantisation, op11_periodic_runs, op12_vantage_point_trees, op13_tsqr_whitening)}
ORACLE_SQL = {"op2_line_templates": line_templates.oracle_sql(), "op6_risk_controlled_rules": quality_rules.oracle_sql()}
