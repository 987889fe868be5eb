"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
a stage's result as Parquet to the shared folder and hands the next stage what
it reads back, so a lost executor never costs more than one stage.  All stages
but the last return the columns of ``documents``.

Files that are read again have no order, so ``run`` puts the mixing schedule
beside the tokens: ``source``, ``source_rank`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.llm import bpe, exact_dedup, langid, minhash, mixing
from cauce.llm.common import DOCUMENT_COLUMNS, materialise
from cauce.llm.queries import public_vocabulary, token_digests

#: A text is rejected when no language reaches this score, or when it has no letter.
MIN_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier recognises; learns from the labelled rows of its own input."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = langid.identify(docs)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    # without any labelled row there is no classifier, and nothing is rejected but texts without a letter
    unlabelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").isEmpty()
    keep = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if unlabelled else known
    return found.where(keep).select(*DOCUMENT_COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs.select(*DOCUMENT_COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return minhash.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the sources' schedule: files and rows follow its slots."""
    return mixing.interleave(docs.select(*DOCUMENT_COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), public_vocabulary("word_bpe_49k.json"))
    return token_digests(encoded)


def tokenize_scheduled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As :func:`tokenize`, with each row's source, rank in its source and slot: ordered by slot and rank, the mix."""
    carry = ["source", "source_rank", "slot"]
    mixed = mixing.mix(docs.select(*DOCUMENT_COLUMNS)).select("doc_id", "text", *carry)
    return token_digests(bpe.encode_documents(mixed, public_vocabulary("word_bpe_49k.json")), *carry)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokenize)]

#: The classifier and the signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if stage is tokenize:
            stage = tokenize_scheduled
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
