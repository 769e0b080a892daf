"""Quality classifier by compression: two zstandard dictionaries and a calibrated size difference.

One dictionary is built from texts labelled good, one from texts labelled bad.
A text is cut into pieces of 256 bytes, so that its own history helps as little
as in a short one, and every piece is compressed with either dictionary.  The
evidence is (bytes with the bad one - bytes with the good one) / bytes of the
text; a logistic curve turns it into the probability of label 1.

The model is fitted on a bounded sample: of each label at most ``sample`` rows
for the dictionaries and as many for the curve, chosen by a hash of their doc_id,
so that any partitioning picks the same ones.  Half of the doc_ids teach the
dictionaries and a quarter the curve; the rest is held out.  The sampled labels
are broadcast (4 * sample rows at most), their texts are written once to the shared folder, and every document is
scored where it is read: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import hash_share, packed, ship
from kohort.session import materialize

ship(__name__)

SAMPLE = 4096  # labelled rows of each label for the dictionaries, and as many for the curve, at most
PIECES = 16384  # distinct pieces of each label that its dictionary is built from, at most: 4 MB
PIECE = 256
DICTIONARY = 1 << 16
LEVEL = 3
BINS = 4096  # evidence is counted in steps of 1 / BINS when the curve is fitted
THRESHOLD = 0.7


@dataclass
class Model:
    """Dictionaries of label 0 and 1 (None: not learned), and the curve's slope and intercept."""
    dictionaries: tuple[bytes, bytes] | None
    raw: tuple[bool, bool]
    slope: float
    intercept: float


def _crc(mod: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def held_out() -> Column:
    """Rows kept out of training: crc32 of the doc_id's text, modulo 4, is 2 (a null doc_id has the empty text)."""
    return _crc(4) == 2


def dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    """(dictionary, whether it is plain content): trained by the library, or, from too few pieces, the pieces."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:], True


def evidence(model: Model):
    """Pandas UDF: (bytes with the bad dictionary - bytes with the good one) / bytes, of whole texts; null and
    empty ones have 0."""
    dictionaries, raw = model.dictionaries, model.raw

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard
        kinds = {True: zstandard.DICT_TYPE_RAWCONTENT, False: zstandard.DICT_TYPE_FULLDICT}
        bad, good = [zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kinds[r]), write_checksum=False,
            write_content_size=False, write_dict_id=False).compress for d, r in zip(dictionaries, raw)]

        def one(text: str | None) -> float:
            if not text:
                return 0.0
            b = text.encode("utf-8", "surrogatepass")
            return sum(len(bad(p)) - len(good(p)) for p in (b[k:k + PIECE] for k in range(0, len(b), PIECE))) / len(b)
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")
    return of


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the curve that fits the counts of both labels at each x, by Newton's method on
    centred and scaled x; targets are drawn in by one row of either label, so that separable counts have a fit."""
    n1, n0 = ones.sum(), zeros.sum()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    weight, target = ones + zeros, (ones * high + zeros * low)
    middle = (weight * x).sum() / weight.sum()
    spread = np.sqrt((weight * (x - middle) ** 2).sum() / weight.sum()) or 1.0
    design = np.stack([(x - middle) / spread, np.ones(len(x))])
    beta = np.array([0.0, np.log(n1 / n0)])

    def loss(b):
        eta = b @ design
        return (weight * np.logaddexp(0, eta) - target * eta).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        step = np.linalg.solve((design * (weight * p * (1 - p))) @ design.T + 1e-9 * np.eye(2), design @ (target - weight * p))
        while loss(beta + step) > loss(beta) + 1e-12 and np.abs(step).max() > 1e-12:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    slope = beta[0] / spread
    return float(slope), float(beta[1] - slope * middle)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learned from the ``labels`` (doc_id, quality) that aren't held out and the texts of ``docs`` (doc_id, text).

    Of each label at most ``sample`` rows are used for either purpose, chosen by a hash of their doc_id.  The curve's
    counts are weighted by how many rows each label has in all.  Rows with another or no quality, or without a
    text, teach nothing; a doc_id with both labels counts for both.  Where a label has no text for a dictionary
    or for the curve, there is no evidence and every score is the share of label 1.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("label")).filter(
        "l_id is not null and label in (0, 1)").withColumn("doc_id", F.col("l_id")).filter(~held_out()).distinct()
    known = known.withColumn("teaches", F.when(_crc(4) == 3, "curve").otherwise("dictionary")).drop("doc_id")
    totals = {(r.label, r.teaches): r.n for r in known.groupBy("label", "teaches").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("l_id", F.lit(11)), "l_id"]
    picked = [known.filter((F.col("label") == k) & (F.col("teaches") == t))
              .filter(hash_share(F.col("l_id"), sample, totals.get((k, t), 0))).orderBy(*order).limit(sample)
              for k in (0, 1) for t in ("dictionary", "curve")]
    few = picked[0].union(picked[1]).union(picked[2]).union(picked[3])  # 4 * sample rows at most
    texts = materialize(docs.select("doc_id", "text").filter("text <> ''")
                        .join(F.broadcast(few), F.col("doc_id") == F.col("l_id")).select("label", "teaches", "l_id", "text"))
    n1, n = sum(v for (k, _), v in totals.items() if k), sum(totals.values())
    share = (n1 + 1) / (n + 2)
    flat = Model(None, (False, False), 0.0, float(np.log(share / (1 - share))))

    learned = []
    cut = F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(PIECE)), lambda at: F.substr("text", at, F.lit(PIECE)))
    for k in (0, 1):
        taught = texts.filter((F.col("label") == k) & (F.col("teaches") == "dictionary"))
        many = taught.agg(F.sum(F.ceil(F.length("text") / PIECE))).first()[0] or 0
        pieces = (taught.select(F.explode(cut).alias("p")).filter(hash_share(F.col("p"), PIECES, many)).distinct()
                  .orderBy(F.xxhash64("p"), "p").limit(PIECES).collect())
        if not pieces:
            return flat
        learned.append(dictionary([r.p.encode("utf-8", "surrogatepass") for r in pieces]))
    model = Model(tuple(d for d, _ in learned), tuple(r for _, r in learned), 0.0, 0.0)

    # a doc_id's texts together weigh as one labelled row
    curve = texts.filter("teaches = 'curve'").withColumn("x", evidence(model)("text"))
    curve = curve.groupBy("label", "l_id").agg(F.avg("x").alias("x"))
    step = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("x") * BINS))).cast("int")
    bins = curve.groupBy("label", step.alias("at")).agg(F.count("*").alias("n")).collect()  # 2 * (2 * BINS + 1) rows at most
    found = {k: sum(r.n for r in bins if r.label == k) for k in (0, 1)}
    if not found[0] or not found[1]:
        return flat
    places = sorted({r.at for r in bins})
    counts = np.zeros((2, len(places)))
    for r in bins:
        counts[r.label, places.index(r.at)] += r.n * totals[r.label, "curve"] / found[r.label]
    model.slope, model.intercept = logistic(np.array(places) / BINS, counts[1], counts[0])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, doc_id, evidence, score) of every row of ``docs`` (doc_id, text and any other columns): ``doc`` is the
    whole row, score the probability of label 1.

    Null and empty texts have no evidence and the score that the curve gives there; repeated rows get the same
    score; an empty table gives no rows.
    """
    rows = packed(docs)
    rows = rows.withColumn("evidence", F.lit(0.0) if model.dictionaries is None else evidence(model)("text"))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.intercept))))
    return rows.select("doc", "doc_id", "evidence", score.alias("score"))


def answers(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
