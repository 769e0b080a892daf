"""Tables laid out by key: no exchange in joins and aggregates, NULL keys, hot keys, another session."""

import tempfile

import pytest
from pyspark.sql import functions as F

from kohort.operators.joins import natural_join
from kohort.sources import layout as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def at(tmp_path):
    return tempfile.mkdtemp(dir=tmp_path)


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def frames(spark):
    left = spark.createDataFrame([(k % 40 or None, f"s{k % 3}", k) for k in range(200)], "a long, b string, v long")
    right = spark.createDataFrame([(k or None, f"s{k % 3}", -k) for k in range(60)] + [(None, None, 7)], "a long, b string, w long")
    return left, right


def test_joins_and_aggregates_need_no_exchange(spark, at, no_broadcast):
    left, right = frames(spark)
    a, b = L.write_laid_out(left, f"{at}/l", ["a"], 4), L.write_laid_out(right.drop("b"), f"{at}/r", ["a"], 4)
    c = L.write_laid_out(right.select("a", F.col("w").alias("z")), f"{at}/z", ["a"], 4)
    for how in ("left", "inner"):
        j = L.join_laid_out(L.join_laid_out(a, b, ["a"], how), c, ["a"], how)
        assert "Exchange" not in plan(j)
        want = natural_join(natural_join(left, right.drop("b"), how), right.select("a", F.col("w").alias("z")), how)
        assert "Exchange" in plan(want)
        assert sorted(map(str, j.select(want.columns).collect())) == sorted(map(str, want.collect()))
    s = L.summary_laid_out(a, ["a"], F.sum("v").alias("s"))
    assert "Exchange" not in plan(L.join_laid_out(a, s, ["a"]))
    assert sorted(map(str, s.select("a", "s").collect())) == sorted(map(str, left.groupBy("a").agg(F.sum("v").alias("s")).collect()))


def test_several_keys_with_nulls_and_clashes(spark, at, no_broadcast):
    left, right = frames(spark)
    a, b = L.write_laid_out(left, f"{at}/l", ["a", "b"], 4), L.write_laid_out(right, f"{at}/r", ["a", "b"], 4)
    want = natural_join(left, right, "left")
    assert sorted(map(str, L.join_laid_out(a, b, ["a", "b"]).select(want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        L.join_laid_out(a, b.withColumn("v", F.lit(1)), ["a", "b"])
    with pytest.raises(ValueError):
        L.write_laid_out(a, f"{at}/x", ["a"], 4)
    texts = spark.createDataFrame([("1:a", "b"), ("1", ":a1:b"), (None, "-"), ("-", None)], "p string, q string")
    assert texts.select(L.layout_key(["p", "q"])).distinct().count() == 4


def test_hot_keys_are_written_without_buckets(spark, at):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("a"), F.col("id").alias("v"))
    hot, even = L.write_laid_out(rows, f"{at}/hot", ["a"], 64), L.write_laid_out(rows, f"{at}/even", ["v"], 64)
    assert "Bucketed: true" in plan(even) or "bucket" in plan(even).lower()
    assert "SelectedBucketsCount" not in plan(hot) and hot.count() == even.count() == 60_000
    j = L.join_laid_out(hot, L.write_laid_out(rows.select("a").distinct().withColumn("w", F.lit(2)), f"{at}/w", ["a"], 64), ["a"])
    assert j.filter("w = 2").count() == 60_000


def test_another_session_and_empty_tables(spark, at, no_broadcast):
    left, right = frames(spark)
    L.write_laid_out(left, f"{at}/l", ["a"], 4)
    L.write_laid_out(right.drop("b").limit(0), f"{at}/r", ["a"], 4)
    for name in ("l", "r"):
        spark.sql(f"DROP TABLE {L._name(f'{at}/{name}')}")  # the catalog forgets; the files stay
    a, b = L.read_laid_out(spark, f"{at}/l"), L.read_laid_out(spark, f"{at}/r")
    j = L.join_laid_out(a, b, ["a"])
    assert "Exchange" not in plan(j) and j.count() == 200 and j.filter("w is not null").count() == 0
    assert a.drop(L.KEY).dtypes == left.dtypes
    L.write_laid_out(left.filter("v < 5"), f"{at}/l", ["a"], 4)
    assert L.read_laid_out(spark, f"{at}/l").count() == 5
