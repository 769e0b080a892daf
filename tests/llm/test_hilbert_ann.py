import random

import numpy as np

from kohort.llm import hilbert_ann as h
from tests.llm.data import clashing


def brute(rows, every=50, k=5):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good.items():
        if q % every == 0:
            s = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i) for i, b in good.items() if i != q)
            out[q] = s[:k]
    return out


def got(spark, rows, **kw):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).withColumnRenamed("n", "window")
    out = {}
    for r in sorted(h.search(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_keys_are_a_walk_along_the_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = h.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side ** 3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_few_rows_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(90)]
    rows += [(200, rows[3][1]), (250, rows[3][1]), (300, rows[3][1]), (300, rows[3][1]), (350, [2 * x for x in rows[5][1]]),
             (400, None), (450, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (550, [float("nan")] * 4),
             (600, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (650, [])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == {}
    assert got(spark, [(0, [1.0, 2.0])]) == {}
    assert got(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])]) == {0: [(-1.0, 1)]}


def test_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6000, 64)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    want = brute(rows)
    found = got(spark, rows)
    assert found.keys() == want.keys() and all(len(x) == 5 for x in found.values())
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in found[q]}) / 5 for q in want]) >= 0.9
    assert found[100] == want[100] and found[150] == want[150]


def test_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((2000, 16))
    many = rng.choice(2000, 900, replace=False)
    v[many] = v[many[0]] * rng.integers(1, 1000, (900, 1)) / 7
    rows = [(k, x.tolist()) for k, x in enumerate(v.astype(np.float64))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(h.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    tied = [q for q in set(many.tolist()) if q % 50 == 0]
    assert tied
    for q in tied:
        assert found[q] == sorted(set(many.tolist()) - {q})[:5]


def test_each_length_is_searched(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(2 + k % 5)]) for k in range(600)]
    want = {}
    for q, x in rows[::50]:
        near = brute([(i, y) for i, y in rows if len(y) == len(x)], every=1)[q]
        want[q] = [i for _, i in near]
    for lengths in (8, 2):  # with and without lengths that have no orderings
        monkeypatch.setattr(h, "LENGTHS", lengths)
        monkeypatch.setattr(h, "MIN_WINDOW", 1000)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = {}
        for r in sorted(h.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append(r.vec_id)
        assert found == want
