"""Corpus preparation: language, near duplicates, benchmark passages, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with their
decisions in effect; the last one returns their tokens. ``run`` writes each stage's result as
Parquet below the cluster's shared folder and reads it again.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapline.llm import decontaminate, jaccard_join, language, pieces, pii  # noqa: E402
from tapline.llm.common import stage  # noqa: E402


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model learns from the rows that aren't held out."""
    model = language.fit(docs.where(~language.held_out()))
    return language.accepted(docs, model)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal values replaced by pseudonyms of their format."""
    return pii.pseudonymised(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded text and digests of the encoded documents."""
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", pseudonymise),
    ("sentencepiece", tokenise),
]

#: Models, suffix automata and subword tokens have no SQL form; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
