"""A training corpus from documents: quality, near duplicates, secrets, mixture, packing.

Every stage takes all rows that the stage before it kept. Between stages the rows are a Parquet
table in the shared folder, which goes as soon as the next stage has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import attention_quality, jaccard_join, mixing, packing, secret_scan, token_counts
from weftline.llm.common import table, written
from weftline.storage import forget

LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those that score less than LEAST_SCORE.

    A null or empty text is one empty passage and scored like others; repeated rows have one score and so one decision;
    without usable labels all stay; an empty table stays empty; columns of any name stay as they are.
    """
    model = attention_quality.train(docs, table(spark, sf_dir, "labels"))
    return attention_quality.accepted(docs, model, least=LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id, a null id last.

    Null and empty texts have no duplicates and stay, each row of them; of repeated rows one stays, and of rows with one id
    but different texts those of different groups; an empty table stays empty; columns of any name stay as they are.
    """
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; every document stays. n_chars, where the table has it, follows the text.

    A null text stays null; repeated rows are each blanked in the same way; overlapping spans become one mark; an empty
    table stays empty; other columns, whatever their names, stay as they are.
    """
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule interleaves their sources: files and their rows are in that order.

    A null source is one of its own; repeated rows and null ids have places of their own, in any order where ids are equal; an
    empty table stays empty; columns of any name stay as they are.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence, in tokens and an end mark each.

    Sequences are numbered in the order of the mixture. A null text is an end mark only; repeated rows and null ids are packed
    like others; texts longer than a sequence are cut; an empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    tokens = token_counts.token_length(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, tokens(F.col("text")) + 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixture", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the packing can't be stated in SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, rows = rows, stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = written(rows, name.replace(" ", "-"))
            if k:
                forget(before)
    return rows
