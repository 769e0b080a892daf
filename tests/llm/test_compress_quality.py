import random
import zlib

import numpy as np
import pytest

from kohort.llm import compress_quality as C
from kohort.llm.common import table
from kohort.llm.queries import QUERIES
from tests.llm.data import clashing, docs


def corpus(n=400, seed=1):
    """Good texts are prose of common words, bad ones shouted lines."""
    r = random.Random(seed)
    good = ["the", "of", "river", "stone", "garden", "water", "because", "between", "yellow", "window"]
    bad = ["BUY!!", "NOW!!", "CHEAP$$$", "CLICK###", "WIN!!", "FREE$$$", "HERE***"]
    rows, labels = [], []
    for k in range(n):
        label = int(r.random() < 0.7)
        rows.append((k, " ".join(r.choice(good if label else bad) for _ in range(r.randrange(5, 300)))))
        labels.append((k, label, 0))
    return rows, labels


def table_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3)


def crc(k):
    return zlib.crc32(str(k).encode()) % 4


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    return rows, labels, C.fit(docs(spark, rows), table_of(spark, labels))


def test_held_out_accuracy(spark, fitted):
    rows, labels, model = fitted
    got = {x.doc_id: x for x in C.answers(docs(spark, rows), model).collect()}
    assert len(got) == len(rows)
    held = [(k, y) for k, y, _ in labels if crc(k) == 2]
    assert all(got[k].held_out == (crc(k) == 2) for k, _, _ in labels)
    assert sum(got[k].predicted == y for k, y in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())


def test_evidence_is_the_size_difference(spark, fitted):
    import zstandard
    rows, _, model = fitted
    two = [zstandard.ZstdCompressor(level=C.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False,
                                    write_content_size=False, write_dict_id=False) for d in model.dictionaries]
    for x in C.scored(docs(spark, rows[:20]), model).collect():
        b = x.doc.text.encode()
        sizes = [sum(len(c.compress(b[i:i + C.PIECE])) for i in range(0, len(b), C.PIECE)) for c in two]
        assert abs(x.evidence - (sizes[0] - sizes[1]) / len(b)) < 1e-12
        assert abs(x.score - 1 / (1 + np.exp(-(model.slope * x.evidence + model.intercept)))) < 1e-12


def test_model_does_not_depend_on_partitions_held_out_rows_or_labels_outside(spark, fitted):
    rows, labels, model = fitted
    # labels of held-out rows turned about, unknown ids, other and null qualities teach nothing
    other = [(k, 1 - y, 0) if crc(k) == 2 else (k, y, 0) for k, y, _ in labels]
    other += [(9_000 + k, 1, 0) for k in range(5) if crc(9_000 + k) == 2] + [(None, 1, 0), (1, None, 0), (1, 7, 0)]
    other += labels[:10]  # repeated labels
    again = C.fit(docs(spark, rows, parts=1), table_of(spark, [x for x in other if not (x in labels[:10] and crc(x[0]) == 2)]).repartition(7))
    assert again.dictionaries == model.dictionaries
    assert (again.slope, again.intercept) == (model.slope, model.intercept)


def test_nulls_empty_long_and_repeated_texts(spark, fitted):
    rows, _, model = fitted
    odd = [(1, None), (2, ""), (3, " ".join(random.Random(4).choices(["river", "stone", "garden", "yellow", "because"], k=50_000))), (4, rows[0][1]), (4, rows[0][1]), (None, "stone")]
    got = [tuple(x) for x in C.answers(clashing(docs(spark, odd)), model).collect()]
    assert len(got) == 6
    score = {k: [g[2] for g in got if g[0] == k] for k in (1, 2, 3, 4, None)}
    empty = 1 / (1 + np.exp(-model.intercept))
    assert abs(score[1][0] - empty) < 1e-12 and score[1] == score[2] and score[4][0] == score[4][1]
    assert score[3][0] > 0.7


def test_missing_labels_give_the_share(spark):
    rows, labels = corpus(60)
    none = C.fit(docs(spark, rows), table_of(spark, [(0, 1, 0)]).filter("doc_id < 0"))
    assert {x.score for x in C.answers(docs(spark, rows), none).collect()} == {0.5}
    ones = C.fit(docs(spark, rows), table_of(spark, [(k, 1, 0) for k, _, _ in labels]))
    n = sum(crc(k) != 2 for k, _, _ in labels)
    got = {x.score for x in C.answers(docs(spark, rows), ones).collect()}
    assert len(got) == 1 and abs(got.pop() - (n + 1) / (n + 2)) < 1e-12
    assert C.answers(docs(spark, rows).filter("doc_id < 0"), ones).count() == 0


def test_sample_is_bounded_and_few_pieces_serve_as_they_are(spark):
    rows, labels = corpus(120, seed=3)
    rows = [(k, t[:40]) for k, t in rows]
    model = C.fit(docs(spark, rows), table_of(spark, labels), sample=2)
    assert model.raw == (True, True) and max(map(len, model.dictionaries)) <= 2 * 40
    got = C.answers(docs(spark, rows), model).collect()
    assert len(got) == 120 and all(0 <= x.score <= 1 for x in got)


def test_logistic_against_its_equations():
    rng = np.random.default_rng(1)
    x = np.sort(rng.normal(size=50))
    ones, zeros = rng.integers(0, 20, 50).astype(float), rng.integers(0, 20, 50).astype(float)
    a, b = C.logistic(x, ones, zeros)
    p = 1 / (1 + np.exp(-(a * x + b)))
    t = ones * (ones.sum() + 1) / (ones.sum() + 2) + zeros / (zeros.sum() + 2)
    assert abs((t - (ones + zeros) * p).sum()) < 1e-6 and abs((x * (t - (ones + zeros) * p)).sum()) < 1e-6
    a, b = C.logistic(np.array([-1.0, 1.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0]))  # separable
    assert np.isfinite([a, b]).all() and a > 0


def test_whole_table_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = QUERIES["op11_compress_quality"](spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    held = [x for x in got if x.held_out and quality.get(x.doc_id) is not None]
    good, bad = ([x.score for x in held if quality[x.doc_id] == k] for k in (1, 0))
    pairs = np.subtract.outer(good, bad)
    auc = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    right = np.mean([x.predicted == quality[x.doc_id] for x in held])
    print("held out", len(held), "area under the curve", auc, "accuracy", right)
    assert auc > 0.99 and right > 0.96
    # calibrated: within each tenth of the scores the mean score is near the share of label 1
    held.sort(key=lambda x: x.score)
    for part in np.array_split(np.array([(x.score, quality[x.doc_id]) for x in held]), 10):
        assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.12
