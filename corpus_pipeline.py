"""A corpus pipeline: language ID, near-dedup, decontamination, secret redaction and mixing.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; the last returns the
mix. run() writes each stage's result to the shared folder, so a lost executor repeats one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontamination, langid, mixing, secrets, simhash
from tamarack.llm._shared import cut, join_checked, steps

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The score at which a prediction overrules a label.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known, and sets lang where it is missing or clearly another.

    Null texts and texts without a letter go, and so do texts that no language's automaton explains in fewer bits
    than random letters would take. A null lang becomes the predicted one, as does a label that a prediction of score SURE or more contradicts.
    """
    held = docs.select(*COLUMNS)
    texts = langid.training_texts(held.where(~langid.held_out()))
    found = langid.predict(held, texts, keep=("doc_id", "lang", "source", "n_chars", "text")).where(~langid.noise())
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest doc_id.

    Documents link if their five-word shingles have a Jaccard likeness of at least 0.8. Rows are told apart by all their
    columns, so those without a doc_id, or with one that others have too, are judged by their texts like any others.
    """
    return simhash.representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark; each row is judged by its own text, whatever its doc_id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = F.struct("doc_id", F.xxhash64("text").alias("text"))
    hit = decontamination.contained(docs.select(own.alias("doc_id"), "text"), items)
    hit = cut(hit.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.text").alias("_text")).distinct(), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    return join_checked(docs, hit, same, "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("mixing", mix),
]

#: SQL expresses neither the suffix automata nor the groups of near duplicates; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with steps(spark) as keep:  # a stage's own tables go once its result is written
            docs = keep(cut(stage(spark, docs, sf_dir), name))
    return docs
