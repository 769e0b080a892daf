"""Corpus preparation: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  Its result is written as Parquet in the shared folder and read again, so
that a lost executor costs the tasks of one stage and no more.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kohort.llm import bpe, decontaminate, langid, line_dedup, simhash
from kohort.llm.common import table
from kohort.llm.queries import VOCABULARY
from kohort.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return langid.identified(docs, min_score=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that stand earlier; those of which nothing is left go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs, width=3, radius=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, decoded_sha256): the documents as token ids, checked by decoding."""
    return bpe.token_rows(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("decontaminate", benchmark),
          ("bpe", encoding)]
ORACLE_SQL = None  # naive Bayes, SimHash and byte-pair merges have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
