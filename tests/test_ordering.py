"""Descending orders as aggregates, against a window."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kohort.operators.aggregate import collapse_multi
from kohort.operators.dedup import first_last_over, first_per_key
from kohort.operators.ordering import order_struct, window_order

TEXTS = ["", "a", "ab", "aa", "a\x00", "b", "é", "ß", "日本", "\U0001F600", "￿", "z", "A", "~", " ", None]


def frame(spark):
    r = random.Random(1)
    rows = [(r.randrange(8), k, r.choice(TEXTS), r.choice([-(1 << 63), (1 << 63) - 1, 0, -1, None]),
             r.choice([-128, 127, 0, None]), r.choice([float("nan"), float("inf"), -1.5, 0.0, None]),
             r.choice([datetime.date(1, 1, 1), datetime.date(2020, 2, 29), None]), r.choice([True, False, None]))
            for k in range(300)]
    return spark.createDataFrame(rows, "k int, id int, s string, big bigint, tiny tinyint, x double, d date, b boolean").repartition(5)


@pytest.mark.parametrize("column", ["s", "big", "tiny", "x", "d", "b"])
@pytest.mark.parametrize("how", ["asc", "desc"])
def test_order_struct_is_the_window_order(spark, column, how):
    df = frame(spark)
    by = [(column, how), "id"]
    w = Window.partitionBy(F.lit(0))
    got = df.select("id", F.row_number().over(w.orderBy(order_struct(df, by))).alias("a"),
                    F.row_number().over(w.orderBy(*window_order(by))).alias("b")).collect()
    assert all(x.a == x.b for x in got) and len(got) == 300


def test_first_collapse_and_first_last_by_descending_text(spark):
    df = frame(spark).filter("s is not null")
    rows = df.collect()
    by = [("s", "desc"), "id"]
    order = {}
    for x in rows:
        order.setdefault(x.k, []).append(x)
    for k in order:
        order[k].sort(key=lambda x: x.id)
        order[k].sort(key=lambda x: x.s.encode(), reverse=True)
    assert {x.k: x.id for x in first_per_key(df, ["k"], by).collect()} == {k: v[0].id for k, v in order.items()}
    got = {x.k: (x.n_records, x.id_1, x.id_2) for x in collapse_multi(df, ["k"], ["id"], by).collect()}
    assert got == {k: (len(v), v[0].id, v[-1].id if len(v) > 1 else None) for k, v in order.items()}
    got = {(x.k, x.id_first, x.id_last) for x in first_last_over(df, ["k"], ["id"], by).collect()}
    assert got == {(k, v[0].id, v[-1].id) for k, v in order.items()}


def test_descending_text_is_a_partial_aggregate(spark):
    df = frame(spark)
    plan = first_per_key(df, ["k"], [("s", "desc")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
