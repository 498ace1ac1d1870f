"""A corpus pipeline of five stages over ``documents``; each stage's result is written as Parquet and read by the next.

1. language ID: documents without a recognisable language go; ``lang`` becomes the predicted language.
2. line dedup: later repeats of runs of lines with 50 words or more are deleted; a document left without text goes.
3. near dedup: one document of each group of near-duplicates (5-word shingles, Jaccard 0.8) stays.
4. mixing: sources are mixed to their target weights; a document stands as often as the mix takes it.
5. byte-level BPE: each document is encoded; its ids and their digests are returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, langid, line_dedup, mixing, near_dedup
from evidentia.llm.queries import RANKS
from evidentia.plans.scratch import written

#: A prediction below this posterior probability counts as rejected.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from every document with a language; keeps those with letters and a prediction of LEAST_SCORE or more."""
    named = langid.predict(docs, langid.fit(docs)).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return named.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs; documents that lose all their words go, those that had none before stay."""
    done = line_dedup.dedup_lines(docs).filter((F.col("removed_lines") == 0) | (F.length(F.trim("text")) > 0))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group, the document with the least doc_id."""
    groups = near_dedup.near_duplicates(docs, 5).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(groups, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets."""
    return mixing.apply_mix(mixing.mix(docs)).select(*COLUMNS)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document of the mix."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode_documents),
]

#: SQL cannot express the stages (a trained classifier, winnowing, BPE); they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
