"""The operators of this subpackage on the generated tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brinewatch.llm.bpe import bpe_report
from brinewatch.llm.byte_bpe import byte_bpe_report, read_ranks
from brinewatch.llm.decontaminate import contamination_report
from brinewatch.llm.fingerprint import fingerprint_report
from brinewatch.llm.near_dedup import near_duplicates
from brinewatch.llm.pii import personal_data_report
from brinewatch.llm.quality import quality_report
from brinewatch.llm.quotations import REPORT_SQL, built_conversations, chats_sql, conversation_report
from brinewatch.llm.resampling import report_sql as resampling_sql
from brinewatch.llm.resampling import resampling_report
from brinewatch.llm.secrets import secrets_report
from brinewatch.llm.substring_dedup import repeat_report
from brinewatch.llm.tables import table
from brinewatch.llm.toxicity import toxicity_report
from brinewatch.llm.vector_codes import compression_report
from brinewatch.llm.vector_codes import report_sql as compression_sql


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quotation_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_report(table(spark, sf_dir, "conversations"))


def op3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_conversations(table(spark, sf_dir, "conversations"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return bpe_report(table(spark, sf_dir, "documents"), file.read())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe_report(table(spark, sf_dir, "documents"), pieces, public_tokenizers.PATTERN)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_decontamination, op3_quotation_chats, op3_conversations, op4_secret_scan, op5_bpe, op6_quality,
        op7_personal_data, op8_fingerprints, op9_substring_dedup, op10_toxicity,
        op11_importance_resampling, op12_byte_bpe, op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {
    "op3_quotation_chats": REPORT_SQL,
    "op3_conversations": chats_sql(),
    "op11_importance_resampling": resampling_sql(),
    "op13_vector_codes": compression_sql(),
}
