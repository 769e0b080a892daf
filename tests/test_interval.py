"""Interval-censored survival against brute force."""

import random

import numpy as np
import pytest

from kohort.operators import survival as S
from kohort.operators.interval import km_interval

INF = 10**9


def slow(rows, steps):
    """Innermost intervals and masses by the definitions, over all subjects and places."""
    closed = []
    for a, b in rows:
        if (a is None and b is None) or (a is not None and b is not None and a > b):
            continue
        closed.append((-INF if a is None else (2 * a if a == b else 2 * a + 1), INF if b is None else 2 * b))
    marks = sorted([(lo, 0) for lo, _ in closed] + [(hi, 1) for _, hi in closed])
    places = sorted({(x[0], y[0]) for x, y in zip(marks, marks[1:]) if (x[1], y[1]) == (0, 1)})
    inside = np.array([[lo <= x and y <= hi for x, y in places] for lo, hi in closed], float)
    p = np.full(len(places), 1 / len(places))
    for _ in range(steps):
        p = (inside * p / (inside @ p)[:, None]).mean(axis=0)
    return places, p


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "l int, r int").repartition(parts)


def random_rows(r, n, most=30):
    rows = []
    for _ in range(n):
        a, b = r.randrange(most), r.randrange(1, 9)
        rows.append(r.choice([(a, a + b), (a, a + b), (a, None), (None, a), (a, a), (a, a + 2)]))
    return rows + [(5, 3), (None, None), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_against_brute_force(spark, seed):
    rows = random_rows(random.Random(seed), 60)
    places, p = slow(rows, 4)
    got = km_interval(frame(spark, rows), "l", "r", max_iter=4, tol=0.0).collect()
    got = sorted((-INF if x.time_left is None else x.time_left, INF if x.time_right is None else x.time_right, x.exact, x.mass, x.surv) for x in got)
    assert len(got) == len(places)
    for k, ((lo, hi), mass, x) in enumerate(zip(places, p, got)):
        assert x[:3] == (-INF if lo == -INF else lo // 2, INF if hi == INF else hi // 2, lo % 2 == 0 and lo > -INF)
        assert x[3] == pytest.approx(mass, abs=1e-10) and x[4] == pytest.approx(max(0.0, 1 - p[:k + 1].sum()), abs=1e-10)


def test_without_intervals_it_is_the_product_limit(spark):
    r = random.Random(3)
    data = [(r.randrange(1, 8), r.random() < 0.6) for _ in range(40)]
    rows = [(t, t if e else None) for t, e in data]
    got = {x.time_right: x.surv for x in km_interval(frame(spark, rows), "l", "r", max_iter=60, tol=1e-7).collect() if x.exact}
    km = S.kaplan_meier(spark.createDataFrame([(t, int(e)) for t, e in data], "t int, e int"), "t", "e").collect()
    for x in km:
        if x.n_event:
            assert got[x.time] == pytest.approx(x.surv, abs=1e-4)


def test_small_inputs(spark):
    assert km_interval(frame(spark, [(1, 2)]).filter("l > 5"), "l", "r").count() == 0
    assert [tuple(x) for x in km_interval(frame(spark, [(1, 4), (2, None)]), "l", "r").collect()] == [(2, 4, False, 1.0, 0.0)]
    assert [tuple(x) for x in km_interval(frame(spark, [(None, None), (3, None)]), "l", "r").collect()] == [(3, None, False, 1.0, 0.0)]
