import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.operators import cox as C
from tests import sixmp


def test_cox_efron_golden(spark):
    df = sixmp.frame(spark)
    fit = C.coxph(df, "time", "event", ["arm"], levels={"arm": ["control", "treated"]})
    assert fit.beta[0] == pytest.approx(-1.5721, abs=1e-4)
    assert fit.se[0] == pytest.approx(0.4124, abs=1e-4)
    assert fit.loglik0 == pytest.approx(-93.1843, abs=1e-4)
    assert fit.loglik == pytest.approx(-85.0084, abs=1e-4)
    t = fit.tests()
    assert t["lr"] == pytest.approx(16.352, abs=1e-3)
    assert t["score"] == pytest.approx(17.247, abs=1e-3)


def _efron_brute(times, events, X, beta):
    """Direct Efron log-likelihood, score and information on raw rows."""
    times, events, X = np.asarray(times, float), np.asarray(events, float), np.asarray(X, float)
    eta = X @ beta
    w = np.exp(eta)
    ll, U, I = 0.0, np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    for t in np.unique(times[events == 1]):
        risk = times >= t
        dead = (times == t) & (events == 1)
        d = dead.sum()
        S0, S1 = w[risk].sum(), (w[risk, None] * X[risk]).sum(0)
        S2 = (w[risk, None, None] * X[risk, :, None] * X[risk, None, :]).sum(0)
        D0, D1 = w[dead].sum(), (w[dead, None] * X[dead]).sum(0)
        D2 = (w[dead, None, None] * X[dead, :, None] * X[dead, None, :]).sum(0)
        ll += eta[dead].sum()
        U += X[dead].sum(0)
        for k in range(d):
            f = k / d
            s0, s1, s2 = S0 - f * D0, S1 - f * D1, S2 - f * D2
            ll -= math.log(s0)
            U -= s1 / s0
            I += s2 / s0 - np.outer(s1, s1) / s0 ** 2
    return ll, U, I


def test_cox_two_covariates_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 300
    g = rng.integers(0, 3, n)
    b = rng.integers(0, 2, n)
    t = np.ceil(rng.exponential(20 / np.exp(0.4 * (g == 1) - 0.6 * (g == 2) + 0.5 * b))).astype(int)
    e = (rng.random(n) < 0.8).astype(int)
    rows = [(i, int(t[i]), int(e[i]), "abc"[g[i]], "yn"[b[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, time bigint, event bigint, g string, b string")
    fit = C.coxph(df, "time", "event", ["g", "b"])
    X = np.column_stack([(g == 1), (g == 2), (b == 0)]).astype(float)  # "y" vs reference "n"
    beta = np.zeros(3)
    for _ in range(30):
        ll, U, I = _efron_brute(t, e, X, beta)
        beta = beta + np.linalg.solve(I, U)
    ll, U, I = _efron_brute(t, e, X, beta)
    assert fit.beta == pytest.approx(beta, abs=1e-8)
    assert fit.loglik == pytest.approx(ll, abs=1e-8)
    assert np.sqrt(np.diag(fit.var)) == pytest.approx(np.sqrt(np.diag(np.linalg.inv(I))), abs=1e-8)
    # martingale residuals sum to zero; Schoenfeld residuals sum to the score (0)
    m = C.martingale_residuals(fit, df, "time", "event", ["g", "b"], "id")
    assert m.agg(F.sum("residual")).collect()[0][0] == pytest.approx(0.0, abs=1e-8)
    s = C.schoenfeld_residuals(fit, df, "time", "event", ["g", "b"], "id")
    for r in s.groupBy("term").agg(F.sum("residual").alias("s")).collect():
        assert r["s"] == pytest.approx(0.0, abs=1e-6)
    assert m.count() == n


def _concordance_brute(times, events, eta):
    """(concordant, discordant, tied, C, infinitesimal-jackknife standard error) from all pairs."""
    n = len(times)
    per = np.zeros((n, 3))
    for i in range(n):
        for j in range(n):
            if i != j and events[i] and (times[j] > times[i] or (times[j] == times[i] and not events[j])):
                kind = 0 if eta[i] > eta[j] else 1 if eta[i] < eta[j] else 2
                per[i, kind] += 1
                per[j, kind] += 1
    c, d, u = per.sum(axis=0) / 2
    pairs = c + d + u
    influence = (per[:, 0] - per[:, 1] - (c - d) / pairs * per.sum(axis=1)) / (2 * pairs)
    return c, d, u, (c + u / 2) / pairs, math.sqrt((influence ** 2).sum())


@pytest.mark.parametrize("kind", ["two levels", "numeric"])
def test_concordance_brute_force(spark, kind):
    rows = [(i, (i * 13) % 17 + 1, int(i % 4 != 0), "ab"[i % 2], (i * 31) % 57 / 8) for i in range(60)]
    if kind == "numeric":  # more distinct scores than any fixed number of columns would hold
        rng = np.random.default_rng(3)
        rows = [(i, int(rng.integers(1, 60)), int(rng.random() < 0.7), "a", float(rng.integers(0, 260)) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, time bigint, event bigint, g string, x double")
    fit = C.coxph(df, "time", "event", ["g"] if kind == "two levels" else ["x"])
    b = float(fit.beta[0])
    eta = [round(b * ((r[3] == "b") if kind == "two levels" else r[4]), 12) for r in rows]
    want = _concordance_brute([r[1] for r in rows], [r[2] for r in rows], eta)
    r = C.concordance(spark, fit).collect()[0]
    assert (r["concordant"], r["discordant"], r["tied_risk"]) == want[:3]
    assert r["concordance"] == pytest.approx(want[3])
    assert r["std_err"] == pytest.approx(want[4])


def test_averaged_curves_over_many_patterns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(1, 30)), int(rng.random() < 0.8), "ab"[int(rng.integers(0, 2))], float(rng.integers(0, 90)) / 30)
            for _ in range(300)]
    df = spark.createDataFrame(rows, "time bigint, event bigint, g string, x double")
    fit = C.coxph(df, "time", "event", ["g", "x"])
    monkeypatch.setattr(C, "PATTERNS_PER_BLOCK", 16)
    base = {r["t"]: r["cumhaz"] for r in C.baseline_table(fit).filter("haz > 0").collect()}
    got = C.adjusted_curves(fit, "g").collect()
    assert len(got) == 2 * len(base)
    for r in got:
        risk = [math.exp(fit.beta[0] * (r["g"] == "b") + fit.beta[1] * x) for *_, x in rows]
        assert r["surv"] == pytest.approx(np.mean([math.exp(-base[r["time"]] * w) for w in risk]))


def test_drop_term_reuses_fit_table_and_matches_fresh_fit(spark):
    rows = [(i, (i * 13) % 29 + 1, int(i % 5 != 0), "abc"[i % 3], "xy"[(i // 3) % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, t bigint, e bigint, g string, h string")
    full = C.coxph(df, "t", "e", ["g", "h"])
    reduced = C.drop_term(df, "t", "e", full, ["g", "h"], "h")
    fresh = C.coxph(df, "t", "e", ["g"])
    assert reduced.loglik == pytest.approx(fresh.loglik, abs=1e-10)
    assert reduced.beta == pytest.approx(fresh.beta, abs=1e-10)
    nt = C.nested_test(spark, full, reduced).collect()[0]
    assert nt["df"] == 1 and nt["chisq"] == pytest.approx(2 * (full.loglik - fresh.loglik))


def test_efron_steps_dealt_out_in_runs(spark, monkeypatch):
    rows = [(i, i % 3 + 1, int(i % 7 != 0), "ab"[(i * i) % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, time bigint, event bigint, g string")
    whole = C.coxph(df, "time", "event", ["g"])
    monkeypatch.setattr(C, "STEPS_PER_ROW", 4)
    runs = C.coxph(df, "time", "event", ["g"])
    assert runs.beta == pytest.approx(whole.beta, abs=1e-10)
    assert runs.loglik == pytest.approx(whole.loglik, abs=1e-9)
    both = [C.baseline_table(f).select("t", "cumhaz").orderBy("t").collect() for f in (whole, runs)]
    assert [r["cumhaz"] for r in both[1]] == pytest.approx([r["cumhaz"] for r in both[0]])
