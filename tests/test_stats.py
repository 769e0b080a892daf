"""Summary statistics and association tests against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.functions.stats import chi2_sf, norm_sf2
from kohort.operators import assoc as A
from kohort.operators import summary as SM


def _type2(x, p):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    j = math.floor(n * p)
    g = n * p - j
    if g > 0:
        return x[j]
    return (x[j - 1] + x[j]) / 2 if j > 0 else x[0]


def test_exact_quantiles_match_definition(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.gamma(2.0, 30.0, 4001), 1)   # heavy tail, many ties
    grp = rng.integers(0, 3, 4001)
    rows = [(int(g), float(v), float(v) * 2) for g, v in zip(grp, vals)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    out = SM.exact_quantiles(df, ["a", "b"], (0.25, 0.5, 0.75), by=["g"], n_buckets=16).collect()
    for r in out:
        x = vals[grp == r["g"]] * (1 if r["variable"] == "a" else 2)
        assert r["n"] == len(x)
        assert r["p25"] == pytest.approx(_type2(x, 0.25))
        assert r["p50"] == pytest.approx(np.median(x))
        assert r["p75"] == pytest.approx(_type2(x, 0.75))


def test_fisher_matches_enumeration(spark):
    cells = {(0, 0): 3, (0, 1): 9, (1, 0): 12, (1, 1): 2}
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "x int, y int")
    got = A.fisher_2x2(df, ["x"], "y").collect()[0]
    a, b, c, d = cells[(0, 0)], cells[(0, 1)], cells[(1, 0)], cells[(1, 1)]
    r1, c1, n = a + b, a + c, a + b + c + d

    def prob(x):
        return math.comb(r1, x) * math.comb(n - r1, c1 - x) / math.comb(n, c1)
    pobs = prob(a)
    p = sum(prob(x) for x in range(max(0, r1 + c1 - n), min(r1, c1) + 1) if prob(x) <= pobs * (1 + 1e-7))
    assert got["p_value"] == pytest.approx(p, rel=1e-9)
    assert (got["a"], got["b"], got["c"], got["d"]) == (a, b, c, d)


def test_chi2_matches_ml_chisquare(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    rows = [(i % 4, (i * 7) % 3 if i % 5 else 0) for i in range(600)]
    df = spark.createDataFrame(rows, "x int, y int")
    ours = A.chi2_test(df, ["x"], "y").collect()[0]
    vec = VectorAssembler(inputCols=["x"], outputCol="f").transform(df.withColumn("x", F.col("x").cast("double")))
    ml = ChiSquareTest.test(vec, "f", "y").collect()[0]
    assert ours["statistic"] == pytest.approx(float(ml.statistics[0]), rel=1e-9)
    assert ours["df"] == int(ml.degreesOfFreedom[0])
    assert ours["p_value"] == pytest.approx(float(ml.pValues[0]), abs=1e-9)


def test_rank_sum_matches_direct(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 80)
    y = rng.integers(3, 25, 70)
    rows = [("a", float(v)) for v in x] + [("b", float(v)) for v in y]
    df = spark.createDataFrame(rows, "g string, v double")
    got = A.rank_sum_test(df, ["v"], "g").collect()[0]
    allv = np.concatenate([x, y]).astype(float)
    order = allv.argsort(kind="stable")
    ranks = np.empty(len(allv))
    sv = allv[order]
    i = 0
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    n1, n2 = len(x), len(y)
    w = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    _, t = np.unique(allv, return_counts=True)
    sigma = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - (t ** 3 - t).sum() / ((n1 + n2) * (n1 + n2 - 1))))
    z = (w - n1 * n2 / 2 - np.sign(w - n1 * n2 / 2) * 0.5) / sigma
    assert got["statistic"] == pytest.approx(w)
    assert got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(norm_sf2(z))


def test_tail_probabilities():
    assert chi2_sf(3.931597, 8) == pytest.approx(0.863242, abs=1e-6)
    assert chi2_sf(1.959964 ** 2, 1) == pytest.approx(0.05, abs=1e-6)
    assert norm_sf2(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(0.0, 3) == 1.0


def test_na_pareto_and_summaries(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (None, 3.0, "a"), (4, 5.0, "b")],
                               "x int, y double, z string")
    p = {r["variable"]: r for r in SM.na_pareto(df).collect()}
    assert set(p) == {"x", "y", "z"}
    assert p["y"]["n_missing"] == 2 and p["y"]["ratio"] == 0.5 and p["y"]["grade"] == "Bad"
    assert p["y"]["cumulative"] == pytest.approx(50.0) and max(r["cumulative"] for r in p.values()) == 100.0
    cat = {(r["level"]): (r["n"], r["pct"]) for r in SM.summary_categorical(df, ["z"], missing=True).collect()}
    assert cat == {"a": (2, pytest.approx(200 / 3)), "b": (1, pytest.approx(100 / 3)), None: (1, None)}


def test_exact_quantiles_linear_matches_numpy(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.normal(50, 20, 999), 0)
    df = spark.createDataFrame([(float(v),) for v in vals], "a double")
    r = SM.exact_quantiles(df, ["a"], (0.1, 0.25, 0.5, 0.9), method="linear", n_buckets=8).collect()[0]
    for p, name in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.9, "p90")):
        assert r[name] == pytest.approx(np.percentile(vals, p * 100))


def test_jvm_tail_probabilities_match_python(spark):
    from kohort.functions import stats as ST
    cases = [(3.931597, 8.0), (3.841459, 1.0), (16.7929, 1.0), (500.0, 3.0), (0.5, 4.0), (0.0, 2.0),
             (30.0, 5.0), (2.0, 25.0), (1e-4, 1.0), (120.0, 100.0), (3.0, 3.0)]
    df = spark.createDataFrame(cases, "x double, k double")
    for r in df.selectExpr("x", "k", f"{ST.chi2_sf_sql('x', 'k')} AS p").collect():
        assert r["p"] == pytest.approx(ST.chi2_sf(r["x"], r["k"]), rel=1e-12, abs=1e-300)
    z = spark.createDataFrame([(1.959964,), (-3.2,), (8.5,)], "z double")
    for r in z.selectExpr("z", f"{ST.norm_sf2_sql('z')} AS p").collect():
        assert r["p"] == pytest.approx(norm_sf2(r["z"]), rel=1e-12)


def test_rank_sum_requires_two_groups(spark):
    rows = [("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 4.0)]
    r = A.rank_sum_test(spark.createDataFrame(rows, "g string, v double"), ["v"], "g").collect()
    assert len(r) == 1 and r[0]["statistic"] is None and r[0]["p_value"] is None


def test_chi2_tail_at_many_degrees_of_freedom(spark):
    from kohort.functions.stats import chi2_sf, chi2_sf_sql
    cases = [(x, df) for df in (1, 10, 1000, 20000, 100000) for x in (df * 0.97, float(df), df * 1.02 + 1)]
    got = spark.createDataFrame(cases, "x double, df bigint").selectExpr("x", "df", f"{chi2_sf_sql('x', 'df')} AS p").collect()
    for r in got:
        assert abs(r.p - chi2_sf(r.x, r.df)) < 1e-9
    assert abs(chi2_sf(20000.0, 20000) - 0.49867) < 1e-5


def test_large_counts_do_not_overflow(spark):
    from kohort.operators.assoc import chi2_test
    cells = spark.createDataFrame([("v", a, g, n) for a, g, n in (("a", "x", 4 * 10**9), ("a", "y", 3 * 10**9),
                                                                  ("b", "x", 3 * 10**9), ("b", "y", 4 * 10**9))],
                                  "variable string, level string, grp string, o bigint")
    assert chi2_test(None, [], "", cells).first().statistic > 1e6


def test_null_keys_are_a_group(spark):
    from kohort.operators.dedup import flag_duplicated, row_number_col
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 2)], "k int, o int")
    assert sorted((r.k or 0, r.o, r.n) for r in row_number_col(df, ["k"], ["o"]).collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 2)]
    assert flag_duplicated(df, ["k"], ["o"]).filter("is_dup").count() == 2


def test_fisher_support_dealt_out_in_runs(spark, monkeypatch):
    from kohort.operators import assoc as A
    rows = [("x" if i % 3 else "y", "p" if i % 5 < 2 else "q") for i in range(70)]
    df = spark.createDataFrame(rows, "v string, g string")
    whole = A.fisher_2x2(df, ["v"], "g").collect()[0]
    monkeypatch.setattr(A, "STEPS_PER_ROW", 3)
    assert A.fisher_2x2(df, ["v"], "g").collect()[0]["p_value"] == pytest.approx(whole["p_value"], abs=1e-12)


def test_rank_sum_broadcasts_what_it_knows_of_a_variable(spark):
    from kohort.operators import assoc as A
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'p', 'q') AS g", "CAST(id * 7 % 20011 AS DOUBLE) AS v")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.rank_sum_test(df, ["v"], "g", n_buckets=64)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert plan.count("strategy=broadcast") >= 2  # groups and borders of a variable, not its values by variable
