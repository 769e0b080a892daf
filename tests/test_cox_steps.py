"""Newton steps on packed moments against the definition, over partitions and border times."""

import random

import numpy as np
import pytest

from kohort.operators import cox as C
from kohort.operators import cox_steps as K


def slow(rows, beta):
    """Log partial likelihood, score and information with Efron's ties, from (t, x, d, m) rows."""
    t, x, d, m = (np.array(c, float) for c in zip(*rows))
    w = np.exp(x @ beta)
    p = len(beta)
    ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
    for s in np.unique(t[d > 0]):
        risk, dead = t >= s, (t == s)
        number = int(d[dead].sum())
        for k in range(number):
            weight = np.where(risk, m * w, 0) - (k / number) * np.where(dead, d * w, 0)
            q = weight.sum()
            mean = weight @ x / q
            ll -= np.log(q)
            u -= mean
            info += (x * weight[:, None]).T @ x / q - np.outer(mean, mean)
        ll += (d * (x @ beta))[dead].sum()
        u += (d[:, None] * x)[dead].sum(axis=0)
    return ll, u, info


def rows(r, n, times, p):
    return [(r.randrange(times), [r.choice([0.0, 1.0, 0.5, -1.0]) for _ in range(p)], float(r.randrange(3)), 2.0 + r.randrange(3)) for _ in range(n)]


def frame(spark, data, p):
    return spark.createDataFrame([(t, *x, d, m) for t, x, d, m in data], "t int, " + ", ".join(f"x{k} double" for k in range(p)) + ", d double, m double")


@pytest.mark.parametrize("per_part, times, p", [(10**6, 12, 2), (20, 40, 3), (15, 3, 2), (25, 1, 1), (7, 400, 4)])
def test_parts(spark, monkeypatch, per_part, times, p):
    monkeypatch.setattr(K, "ROWS_PER_PART", per_part)
    r = random.Random(times)
    data = rows(r, 150, times, p)
    table, parts = K.laid_out(frame(spark, data, p), [f"x{k}" for k in range(p)], len(data))
    assert (parts > 1) == (per_part < 150)
    beta = np.array([r.uniform(-1, 1) for _ in range(p)])
    got, want = K.newton_parts(table, parts, beta), slow(data, beta)
    assert got[0] == pytest.approx(want[0], rel=1e-11)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got[2], want[2], rtol=1e-9, atol=1e-9)


def test_same_fit_over_many_partitions(spark, monkeypatch):
    r = random.Random(5)
    data = [(r.randrange(1, 60), int(r.random() < 0.5), r.choice("abc"), r.random()) for _ in range(400)]
    df = spark.createDataFrame(data, "t int, e int, g string, z double")
    one = C.coxph(df, "t", "e", ["g", "z"])
    monkeypatch.setattr(K, "ROWS_PER_PART", 30)
    many = C.coxph(df, "t", "e", ["g", "z"])
    np.testing.assert_allclose(one.beta, many.beta, rtol=1e-8)
    np.testing.assert_allclose(one.var, many.var, rtol=1e-8)
    assert one.loglik == pytest.approx(many.loglik, rel=1e-12)


def test_two_hundred_levels(spark):
    r = random.Random(6)
    data = [(r.randrange(1, 300), int(r.random() < 0.7), f"g{k % 200:03d}") for k in range(6000)]
    fit = C.coxph(spark.createDataFrame(data, "t int, e int, g string"), "t", "e", ["g"])
    assert fit.p == 199 and fit.converged and np.isfinite(fit.se).all()


def test_no_events_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "t int, e int, z double")
    fit = C.coxph(df, "t", "e", ["z"], max_iter=2)
    assert fit.loglik == 0.0 and fit.n_events == 0
    assert C.coxph(df.filter("t > 5"), "t", "e", ["z"], max_iter=2).n == 0
