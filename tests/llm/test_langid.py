import binascii
import random

import numpy as np
from pyspark.sql import functions as F

from kohort.llm import langid
from kohort.llm.common import table
from tests.llm.data import clashing, docs


def test_held_out_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = (langid.identify(d).select(langid.held_out().alias("h"), "doc.lang", "lang_pred", "score")
            .filter("h and lang is not null").collect())
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def slow_grams(text):
    """Sorted buckets of the whole text at once, one by one."""
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" ")) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    out, m = [], 2**64 - 1
    for n in langid.ORDERS:
        for k in range(len(t) - n + 1):
            h = 0x9E3779B97F4A7C15 * n & m
            for c in t[k:k + n]:
                h = (h ^ ord(c)) * 0xBF58476D1CE4E5B9 & m
                h ^= h >> 29
            out.append(h >> 17 & langid.BUCKETS - 1)
    return sorted(out)


def test_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    syll = {"en": ["th", "ing", "he"], "de": ["sch", "ung", "ü"], "fr": ["eau", "é", "que"]}
    rows = [(k, " ".join("".join(rng.choice(syll[g]) for _ in range(3)) for _ in range(rng.choice([1, 20]))), g)
            for k in range(90) for g in [rng.choice(list(syll))]]
    rows += [(500, None, "en"), (501, "12 34", "en"), (502, "", None), (503, "the", None), (None, "schung", "de"), (504, "thing " * 90000, None)]
    train = [(t, g) for i, t, g in rows if t is not None and g is not None
             and binascii.crc32(("" if i is None else str(i)).encode()) % 5 != 0]
    langs = sorted({g for _, g in train})
    counts = {g: np.full(langid.BUCKETS, 0.1) for g in langs}
    for t, g in train:
        np.add.at(counts[g], slow_grams(t), 1)
    want = []
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0))
            continue
        s = np.array([np.log(sum(x == g for _, x in train) / len(train)) + np.log(counts[g] / counts[g].sum())[slow_grams(t)].sum()
                      for g in langs])
        p = np.exp(s - s.max())
        want.append((i, langs[int(s.argmax())], round(float(p.max() / p.sum()), 3)))
    d = clashing(docs(spark, rows)).withColumnRenamed("n", "found")
    got = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.identify(d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pieces_lose_no_gram():
    text = "straße und ünder " * 40000
    got = np.concatenate(list(langid.grams(text, langid.letters())))
    assert sorted(got.tolist()) == slow_grams(text)


def test_nothing_learned_and_filter(spark):
    assert langid.identify(docs(spark, [])).count() == 0
    assert [(r.lang_pred, r.score) for r in langid.identify(docs(spark, [(1, "abc", None)])).collect()] == [("und", 0.0)]
    rows = [(k, "the thing here", "en") for k in range(20)] + [(30, "123", "en"), (31, None, "en")]
    kept = langid.identified(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 20
    assert kept.agg(F.max("doc_id")).first()[0] == 19
