"""A training-data pipeline over ``documents``: five stages, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import bpe, decontaminate, language_id, near_dup, secrets_scan
from searchloom.llm.common import bound_batches, materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def carried(docs: DataFrame) -> DataFrame:
    """The columns of documents, and ``lang_score`` once the language stage has added it."""
    return docs.select(*COLUMNS, *(c for c in docs.columns if c == "lang_score"))


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with batches to Python workers that are bounded in bytes."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the language found in place of the label, with its probability as
    ``lang_score``; both go on to the result.  Drops documents whose language the models
    reject (texts that are null, empty, without letters, or unlike every language
    learned; no learned text is unlike all) or leave open: no language more probable than
    all others together.  Learns from the labelled rows; without any, every text with
    letters is ``und`` and stays.  Repeated rows are judged alike, columns beside those of
    documents are left out."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select(*COLUMNS), model).where(~F.col("rejected") & (F.col("score") > 0.5))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars", F.col("score").alias("lang_score"))


@bounded
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest doc_id (five-word shingles,
    similarity 0.8).  Rows that repeat a doc_id are one document: they stay or go
    together; rows without one, and texts without words, stay."""
    groups = near_dup.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return carried(docs.join(gone, docs.doc_id == gone.gone_id, "left_anti"))


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``, each row by its own text;
    null and empty texts stay."""
    return carried(decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark")))


@bounded
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark and counts their characters again; every
    row stays, null and empty texts as they are."""
    forest = secrets_scan.train(secrets_scan.labelled_findings())
    clean = secrets_scan.redacted(carried(docs), forest)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


@bounded
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row, in place of its text, the ids of the text, their number and the digests of
    ids and of the text that they decode to; null and empty texts have no ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(carried(docs), path).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("near_dup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("bpe", token_stage),
]

#: SQL cannot express the stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
