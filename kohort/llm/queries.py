"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm import (bpe, chat_format, compress_quality, decontaminate, hilbert_ann, langid, license_scan, line_dedup, periodic_runs,
                        pii, simhash, spelling, url_filter)
from kohort.llm.common import table

# The rules of the URL query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
VOCABULARY = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", F.col("new_text").alias("text"), "n_lines", "n_removed")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_format.paired(chat_format.rendered(chat_format.swapped_sides(turns)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", simhash.hex_fp("fp").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.matched(docs, table(spark, sf_dir, "benchmark"), window=10))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compress_quality.answers(docs, compress_quality.fit(docs, table(spark, sf_dir, "labels")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.occurrences(table(spark, sf_dir, "documents"))
    words = runs.select(spelling.thinned(F.col("doc_id"), F.col("run")).alias("word"))
    return spelling.spelling_groups(spelling.vocabulary(words))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(docs)))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_simhash, op4_decontaminate, op5_license_scan, op6_bpe,
                                   op7_langid, op8_hilbert_ann, op9_url_filter, op10_pii, op11_compress_quality,
                                   op12_spelling, op13_periodic_runs)}
ORACLES = {"op2_chat_format": chat_format.ORACLE}
