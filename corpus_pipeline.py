"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact, encode.

``STAGES`` lists ``(name, function)``. Each function takes ``(spark, docs, sf_dir)``, works on all rows of
``docs`` and returns what the next stage reads; all but the last return the columns of ``docs``. Rows with a
null or empty text, without id, or that repeat pass through the rules stated at each stage; columns of
``docs`` may bear any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewatch.llm.bpe import bpe_round_trip
from brinewatch.llm.decontaminate import RESULT as FOUND_COLUMNS
from brinewatch.llm.decontaminate import find_contamination
from brinewatch.llm.near_dedup import near_duplicates
from brinewatch.llm.pii import redact
from brinewatch.llm.quality import good_documents
from brinewatch.llm.tables import fresh, table
from brinewatch.session import checkpointed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that an operator would overwrite; the map leads back to their names."""
    moved = {c: fresh(docs, f"own_{c}") for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty texts are scored like others."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id stays, once; rows without id all stay."""
    classes = near_duplicates(docs.select("doc_id", "text"))
    kept = classes.where("class_id = doc_id").select("doc_id").distinct()
    # Deal out by id once, for the join and for rows that repeat.
    stay = docs.repartition("doc_id").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.select(docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    moved, back = _aside(docs, FOUND_COLUMNS.names)
    found = find_contamination(moved, table(spark, sf_dir, "benchmark")).where(F.size("span_start") == 0)
    return found.drop(*FOUND_COLUMNS.names).withColumnsRenamed(back).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; lengths follow, null texts stay null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of every text, and a digest of what they decode to; the results' names win."""
    with open(TOKENIZER, encoding="utf-8") as file:
        tokenizer = file.read()
    done = bpe_round_trip(docs, tokenizer)
    return done.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", bpe),
]

#: Learnt scores, hashing and encoding are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
