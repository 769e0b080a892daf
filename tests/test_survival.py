
import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.operators import survival as S
from tests import sixmp


def test_km_treated_arm_golden(spark):
    df = sixmp.frame(spark).filter(F.col("arm") == "treated")
    km = {r["time"]: r for r in S.kaplan_meier(df, "time", "event").collect()}
    # classic product-limit values for the 6-MP arm
    assert km[6]["n_risk"] == 21 and km[6]["n_event"] == 3
    assert km[6]["surv"] == pytest.approx(0.857143, abs=1e-6)
    assert km[7]["surv"] == pytest.approx(0.806723, abs=1e-6)
    assert km[10]["surv"] == pytest.approx(0.752941, abs=1e-6)
    assert km[13]["surv"] == pytest.approx(0.690196, abs=1e-6)
    assert km[16]["surv"] == pytest.approx(0.627451, abs=1e-6)
    assert km[22]["surv"] == pytest.approx(0.537815, abs=1e-6)
    assert km[23]["surv"] == pytest.approx(0.448179, abs=1e-6)


def test_km_without_censoring_is_one_minus_ecdf(spark):
    df = sixmp.frame(spark).filter(F.col("arm") == "control")
    km = S.kaplan_meier(df, "time", "event").orderBy("time").collect()
    n = len(sixmp.CONTROL)
    for r in km:
        expect = 1 - sum(1 for t in sixmp.CONTROL if t <= r["time"]) / n
        assert r["surv"] == pytest.approx(expect, abs=1e-12)


def test_km_non_increasing_and_partition_independent(spark):
    df = sixmp.frame(spark)
    a = S.kaplan_meier(df.repartition(1), "time", "event", by=["arm"], n_buckets=2).collect()
    b = S.kaplan_meier(df.repartition(7), "time", "event", by=["arm"], n_buckets=1024).collect()
    key = lambda r: (r["arm"], r["time"])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [(r["arm"], r["time"], round(r["surv"], 12)) for r in a] == \
           [(r["arm"], r["time"], round(r["surv"], 12)) for r in b]
    for arm in ("treated", "control"):
        s = [r["surv"] for r in a if r["arm"] == arm]
        assert all(x >= y for x, y in zip(s, s[1:])) and all(0 <= x <= 1 for x in s)


def test_logrank_golden(spark):
    t = {r["arm"]: r for r in S.logrank_test(sixmp.frame(spark), "time", "event", "arm").collect()}
    assert t["treated"]["observed"] == 9
    assert t["treated"]["expected"] == pytest.approx(19.2505, abs=1e-4)
    assert t["treated"]["chisq"] == pytest.approx(16.7929, abs=1e-4)
    assert t["treated"]["df"] == 1
    assert t["treated"]["observed"] + t["control"]["observed"] == pytest.approx(
        t["treated"]["expected"] + t["control"]["expected"])


def _logrank_brute(times, events, groups):
    levels = sorted(set(groups))
    k = len(levels)
    O, E, V = np.zeros(k), np.zeros(k), np.zeros((k, k))
    times, events, groups = map(np.array, (times, events, groups))
    for t in sorted(set(times[events == 1])):
        at = times >= t
        n = at.sum()
        d = ((times == t) & (events == 1)).sum()
        ng = np.array([(at & (groups == g)).sum() for g in levels], float)
        dg = np.array([((times == t) & (events == 1) & (groups == g)).sum() for g in levels], float)
        O += dg
        E += d * ng / n
        if n > 1:
            w = d * (n - d) / (n - 1)
            V += w * (np.diag(ng / n) - np.outer(ng / n, ng / n))
    diff = (O - E)[:-1]
    return levels, O, E, float(diff @ np.linalg.solve(V[:-1, :-1], diff))


def test_logrank_k_groups_matches_brute_force(spark):
    rows = [(i, (i * 37) % 23 + 1, int(i % 3 != 0), "abcd"[i % 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, time bigint, event bigint, g string")
    got = {r["g"]: r for r in S.logrank_test(df, "time", "event", "g").collect()}
    levels, O, E, x2 = _logrank_brute([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    for i, g in enumerate(levels):
        assert got[g]["observed"] == pytest.approx(O[i])
        assert got[g]["expected"] == pytest.approx(E[i])
        assert got[g]["chisq"] == pytest.approx(x2)
        assert got[g]["df"] == 3


def test_delayed_entry_risk_set(spark):
    rows = [(0, 5, 1), (2, 6, 0), (3, 4, 1), (4, 8, 1), (6, 6, 1)]  # last row: stop <= start, dropped
    df = spark.createDataFrame(rows, "start bigint, stop bigint, event bigint")
    km = {r["time"]: r for r in S.km_delayed_entry(df, "start", "stop", "event").collect()}
    # at t=4: entered (start<4) = 3 (0,2,3); exited before 4 = 0 -> 3 at risk
    assert km[4]["n_risk"] == 3 and km[4]["n_event"] == 1
    # at t=5: start<5 -> 4 subjects; stop<5 -> 1 -> 3 at risk
    assert km[5]["n_risk"] == 3
    assert km[8]["n_risk"] == 1
    assert km[8]["surv"] == pytest.approx((2 / 3) * (2 / 3) * 0.0)
    assert 6 in km and km[6]["n_event"] == 0


def test_median_and_limits_order(spark):
    df = sixmp.frame(spark)
    km = S.kaplan_meier(df, "time", "event", by=["arm"])
    m = {r["arm"]: r for r in S.km_summary(km, by=["arm"]).collect()}
    # control arm: 21 events, median 8 (published); treated arm median 23
    assert m["control"]["median"] == 8 and m["treated"]["median"] == 23
    for r in m.values():
        assert r["lower_ci"] is None or r["lower_ci"] <= r["median"]
        assert r["upper_ci"] is None or r["upper_ci"] >= r["median"]
    assert m["control"]["records"] == 21 and m["control"]["events"] == 21


def test_logrank_many_equals_one_at_a_time(spark):
    rows = [(i, (i * 37) % 23 + 1, int(i % 3 != 0), "abcd"[i % 4], "xy"[(i // 7) % 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, time bigint, event bigint, g string, h string")
    many = {(r["variable"], r["level"]): r for r in S.logrank_many(df, "time", "event", ["g", "h"]).collect()}
    for g in ("g", "h"):
        for r in S.logrank_test(df, "time", "event", g).collect():
            m = many[(g, r[g])]
            for c in ("n", "observed", "expected", "oe2_v", "chisq", "df", "p_value"):
                assert m[c] == pytest.approx(r[c])


def test_logrank_many_levels_and_buckets_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(1, 40)), int(rng.random() < 0.7), int(rng.integers(0, 230))) for _ in range(2500)]
    df = spark.createDataFrame(rows, "time bigint, event bigint, g int")
    monkeypatch.setattr(S, "CELLS_PER_BUCKET", 400)
    monkeypatch.setattr(S, "GRID", 1000)
    got = {r["g"]: r for r in S.logrank_test(df, "time", "event", "g").collect()}
    levels, O, E, x2 = _logrank_brute(*zip(*rows))
    assert sorted(got) == levels
    for i, g in enumerate(levels):
        assert got[g]["observed"] == pytest.approx(O[i])
        assert got[g]["expected"] == pytest.approx(E[i])
        assert got[g]["chisq"] == pytest.approx(x2, rel=1e-6)


def test_range_buckets_stay_even_beside_an_outlier(spark):
    from kohort.operators.prefix import scaled_buckets
    df = spark.range(20_000).selectExpr("id % 2 AS k", "IF(id = 7, 1e15, CAST(id AS DOUBLE)) AS t")
    for part, rows in ((["k"], 10_000), ([], 20_000)):
        sizes = scaled_buckets(df, part, "t", 64, name="b").groupBy(*part, "b").count().collect()
        assert max(r["count"] for r in sizes) <= 2 * rows / 64
        order = scaled_buckets(df, part, "t", 64, name="b").groupBy(*part, "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
        for k in {tuple(r[c] for c in part) for r in order}:
            mine = sorted((r["b"], r["lo"], r["hi"]) for r in order if tuple(r[c] for c in part) == k)
            assert all(a[2] < b[1] for a, b in zip(mine, mine[1:]))


def test_range_buckets_need_no_shuffle_by_partition(spark, monkeypatch):
    from kohort.operators import prefix
    df = spark.range(20_000).selectExpr("IF(id % 10 < 9, 0, id % 10 * 1000 + id) AS k", "CAST(id AS DOUBLE) AS t")
    few = df.selectExpr("k > 0 AS k", "t")
    plan = prefix.scaled_buckets(few, ["k"], "t", 64)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(prefix, "MAX_BORDERS", 1000)  # more partitions than may be broadcast, and one hot
    b = prefix.scaled_buckets(df, ["k"], "t", 64, name="b")
    assert "Join" not in b._jdf.queryExecution().executedPlan().toString()
    assert b.groupBy("k", "b").count().agg(F.max("count")).first()[0] <= 2 * 20_000 / 64
    got = prefix.running_aggs(b.withColumn("one", F.lit(1)), ["k"], "t", sums={"n": "one"}, bucket_col="b")
    assert got.filter("k = 0").agg(F.count_distinct("n"), F.max("n")).first()[:] == (18_000, 18_000)
