"""A training corpus from ``documents``: quality, language, near copies, leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of
``documents`` for the rows it keeps; the last returns the packed pieces. Between
stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeprism.llm import decontaminate, language_id, near_copies, packing, quality
from codeprism.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the learning labels) predicts to be good."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return docs.where(quality.quality_score(F.col("text"), model) >= 0.5).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: told, likelier than not, and with enough words at home in it."""
    learn = ~language_id.held_out(F.col("doc_id"))
    model = language_id.fit_home(language_id.fit_languages(docs, learn), docs, learn)
    return docs.where(language_id.at_home(F.col("text"), model)).select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return near_copies.drop_near_copies(docs).select(*COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", keep_clean),
    ("packing", pack),
]

#: A fitted classifier, hashing and a tokenizer stand in the way of SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
