"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language over all training rows, as a
Spark aggregation.  The log-probability matrix (languages x 2^14 buckets) is
broadcast; its size is bounded by the number of languages, which is checked.
Texts are scored in numpy as a sparse batch: the n-gram buckets of a batch of
texts lie in one index array with row offsets, the matrix columns are
gathered, and each row's segment is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import packed, ship

ship(__name__)

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_LANGS = 512  # 512 x 2^14 float32 = 32 MB, the bound of what is broadcast
PIECE = 1 << 18  # characters scored at a time
UNKNOWN = "und"
SCORED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letters() -> np.ndarray:
    """Whether a code point of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(text: str, is_letter: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in pieces that overlap by the longest order less one.

    Lower case; whatever isn't a letter counts as one space, runs of them as
    a single one.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(is_letter[np.minimum(c, 0xFFFF)] | (c > 0xFFFF), c, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    longest = max(ORDERS)
    for at in range(0, len(c), PIECE):
        part = c[at:at + PIECE + longest - 1]
        out = []
        for n in ORDERS:
            starts = min(PIECE, len(part) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for k in range(n):
                h = (h ^ part[k:k + starts]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(17)) & np.uint64(BUCKETS - 1))
        if out:
            yield np.concatenate(out).astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over ``rows`` (text, lang); each task sums before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter, sums = letters(), {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams(text, is_letter):
                    total += np.bincount(g, minlength=BUCKETS)
        for lang, total in sums.items():
            hit = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "bucket": hit, "n": total[hit]})

    parts = rows.mapInPandas(count, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) learned from all ``rows`` (text, lang); rows lacking either are left out.

    Raises if there are more than MAX_LANGS languages: the matrix is broadcast.
    """
    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(shares) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in the training rows")
    langs = sorted(r.lang for r in shares)
    prior = {r.lang: r.n for r in shares}
    at = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((len(langs), BUCKETS), smoothing)
    # one row a language: as many numbers as the matrix that is broadcast
    filled = gram_counts(rows).groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    for r in filled.toLocalIterator():
        counts[at[r.lang], r.b] += r.n
    log = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    first = np.log([prior[lang] / sum(prior.values()) for lang in langs]) if langs else np.zeros(0)
    return langs, np.concatenate([log.T, first[None, :]]).astype(np.float32) if langs else np.zeros((BUCKETS + 1, 0), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """Column struct(lang_pred, score): the likeliest language and its posterior probability.

    A text that is null or has no letter, and every text where nothing was
    learned, is ``und`` with score 0.  Equal probabilities go to the first
    language in alphabetical order.
    """
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter, weights = letters(), sent.value

        def flush(index, rows, sums):
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in index])[:-1]])
            np.add.at(sums, rows, np.add.reduceat(weights[np.concatenate(index)], offsets, axis=0, dtype=np.float64))

        for texts in batches:
            sums = np.tile(weights[BUCKETS].astype(np.float64), (len(texts), 1))
            known = np.zeros(len(texts), bool)
            index, rows, held = [], [], 0
            for k, t in enumerate(texts):
                if not langs or not t or not any(map(str.isalpha, t)):
                    continue
                known[k] = True
                for g in grams(t, is_letter):
                    index.append(g)
                    rows.append(k)
                    held += len(g)
                    if held > PIECE:
                        flush(index, rows, sums)
                        index, rows, held = [], [], 0
            if index:
                flush(index, rows, sums)
            if langs:
                best = sums.argmax(axis=1)
                top = sums.max(axis=1)
                prob = 1 / np.exp(sums - top[:, None]).sum(axis=1)
                names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            else:
                prob, names = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            yield pd.DataFrame({"lang_pred": names, "score": np.where(known, prob, 0.0)})

    return score(text)


def held_out() -> Column:
    """Rows kept out of training: crc32 of the doc_id's text, modulo 5, is 0 (a null doc_id has the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text, lang_pred, score) of every row: ``doc`` is the whole row, the prediction is
    learned from the rows that aren't held out.

    Null texts and langs are left out of training; repeated rows count as
    often as they occur; an empty table gives no rows.
    """
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return (packed(docs).withColumn("found", predict(docs, model))
            .select("doc", "doc_id", "text", "found.lang_pred", "found.score"))


def identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` whose language is known: not ``und``, and more likely than all others together."""
    return identify(docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("doc.*")
