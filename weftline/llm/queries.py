"""Queries of the operators and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_quality, block_ann, context_tree, jaccard_join, line_quality, mixing, oracle, packing, secret_scan, token_counts, warc_store
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.page_records(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_block_ann, op3_pfair_mixing, op4_attention_quality, op5_warc_store, op6_token_counts, op7_jaccard_join, op8_secret_scan, op9_context_tree, op10_line_quality)}
ORACLE: dict[str, str] = {"op2_block_ann": oracle.OP2, "op5_warc_store": oracle.OP5, "op7_jaccard_join": oracle.OP7, "op10_line_quality": oracle.OP10}
