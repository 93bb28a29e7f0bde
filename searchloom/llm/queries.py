"""The driver's queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, language_id, language_model, license_scan, near_dup, quality_rules, secrets_scan, token_files
from .common import crc_mod, read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role)").withColumn("text", F.lit(both))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.unionByName(own))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = language_model.language_model_scores(docs, crc_mod("doc_id", 7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(license_scan.PATH_SQL).alias("path"))
    return license_scan.scan(docs)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets_scan.train(secrets_scan.labelled_findings())
    return secrets_scan.findings(read_table(spark, sf_dir, "documents"), forest)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_lm_score, op3_decontaminate, op4_license_scan, op5_token_files, op6_quality_rules, op7_secrets, op8_language_id, op9_near_dup, op10_bpe)
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat_format.DIGESTS_SQL, "op4_license_scan": license_scan.scan_sql(), "op6_quality_rules": quality_rules.MEASURED_SQL}
