"""Property tests on random small inputs against direct computation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kohort.operators import aggregate as agg
from kohort.operators import survival as S

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

surv_rows = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1), st.sampled_from(["a", "b", "c"])),
                     min_size=1, max_size=60)


def km_brute(times, events):
    out = {}
    s = 1.0
    for t in sorted(set(times)):
        n = sum(1 for x in times if x >= t)
        d = sum(1 for x, e in zip(times, events) if x == t and e == 1)
        s *= 1 - d / n
        out[t] = (n, d, s)
    return out


@settings(**SETTINGS)
@given(rows=surv_rows)
def test_km_matches_product_limit(spark, rows):
    df = spark.createDataFrame(rows, "time int, event int, g string")
    got = S.kaplan_meier(df, "time", "event", by=["g"], n_buckets=3).collect()
    for g in {r[2] for r in rows}:
        sub = [(t, e) for t, e, gg in rows if gg == g]
        want = km_brute([t for t, _ in sub], [e for _, e in sub])
        mine = {r["time"]: r for r in got if r["g"] == g}
        assert set(mine) == set(want)
        for t, (n, d, s) in want.items():
            assert mine[t]["n_risk"] == n and mine[t]["n_event"] == d
            assert mine[t]["surv"] == pytest.approx(s, abs=1e-12)


rec_rows = st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9)),
                              st.one_of(st.none(), st.sampled_from(["x", "y", "z"]))),
                    min_size=1, max_size=40)


@settings(**SETTINGS)
@given(rows=rec_rows)
def test_collapse_matches_pandas(spark, rows):
    data = [(k, o, v, i) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, o int, v string, id int")
    got = {r["k"]: r for r in agg.collapse_multi(df, ["k"], ["v"], ["o", "id"]).collect()}
    pdf = pd.DataFrame(data, columns=["k", "o", "v", "id"])
    for k, g in pdf.groupby("k"):
        # order: o ascending with NULL last, then id
        g = g.assign(_n=g["o"].isna()).sort_values(["_n", "o", "id"])
        first, last = g.iloc[0]["v"], g.iloc[-1]["v"]
        norm = lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else x
        assert got[k]["n_records"] == len(g)
        assert got[k]["v_1"] == norm(first)
        assert got[k]["v_2"] == (norm(last) if len(g) > 1 else None)


def _type2(x, p):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    j = int(np.floor(n * p))
    return x[j] if n * p - j > 0 else (x[j - 1] + x[j]) / 2


@settings(**SETTINGS)
@given(vals=st.lists(st.integers(-50, 50), min_size=2, max_size=80),
       nb=st.integers(1, 12))
def test_quantiles_match_definitions(spark, vals, nb):
    from kohort.operators import summary as SM
    df = spark.createDataFrame([(float(v),) for v in vals], "a double")
    t2 = SM.exact_quantiles(df, ["a"], (0.25, 0.5, 0.75), n_buckets=nb).collect()[0]
    lin = SM.exact_quantiles(df, ["a"], (0.1, 0.5, 0.9), n_buckets=nb, method="linear").collect()[0]
    for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        assert t2[name] == pytest.approx(_type2(vals, p))
    for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")):
        assert lin[name] == pytest.approx(np.percentile(vals, p * 100))


@settings(**SETTINGS)
@given(a=st.lists(st.integers(0, 8), min_size=1, max_size=30), b=st.lists(st.integers(0, 8), min_size=1, max_size=30))
def test_rank_sum_statistic(spark, a, b):
    from kohort.operators import assoc as A
    rows = [("g1", float(v)) for v in a] + [("g2", float(v)) for v in b]
    got = A.rank_sum_test(spark.createDataFrame(rows, "g string, v double"), ["v"], "g").collect()[0]
    allv = np.array([r[1] for r in rows])
    ranks = np.array([(allv < v).sum() + ((allv == v).sum() + 1) / 2 for v in allv])
    w = ranks[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    assert got["statistic"] == pytest.approx(w)
    assert (got["n1"], got["n2"]) == (len(a), len(b))


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-5, 5)),
                               st.one_of(st.none(), st.sampled_from(["", "a", "ab", "b", "Z"]))),
                     min_size=1, max_size=60),
       n_ranges=st.integers(1, 7), desc=st.booleans(), text_first=st.booleans())
def test_row_number_matches_window(spark, rows, n_ranges, desc, text_first):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from kohort.operators import dedup
    data = [(k, v, s, i) for i, (k, v, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, v int, s string, id int")
    first = "s" if text_first else "v"
    how = "desc" if desc else "asc"
    got = dedup.row_number_col(df, ["k"], [(first, how), "id"], "n", n_ranges=n_ranges)
    o = F.col(first).desc_nulls_last() if desc else F.col(first).asc_nulls_last()
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(o, F.col("id"))))
    assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted((r["id"], r["n"]) for r in want.collect())
