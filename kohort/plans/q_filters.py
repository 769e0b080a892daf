"""Registered queries: filters (C) and joins (D)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from kohort.functions import dates as D
from kohort.functions.nulls import isin_or_false, rlike_or_false
from kohort.operators import aggregate as agg
from kohort.operators import dedup
from kohort.operators import filters as flt
from kohort.operators import joins as J
from kohort.operators.lookup import literal_table
from kohort.plans import fixtures as fx
from kohort.plans.q_aggregate import SESS_HI, SESS_LO
from kohort.plans.registry import register
from kohort.session import checkpoint_dir
from kohort.sources import layout
from kohort.sources.io import table

# Subjects excluded outright, and the conditional exclusion.
EXCLUDED_SUBJECTS = [3, 17, 42]
CONDITIONAL_EXCLUSION = (5, "result", "[Cc]lick")


@register("filter_ne_null_drop", fixtures=("fx_rec",), sql="""
SELECT subject_id, record_id, stage FROM fx_rec WHERE stage <> 'distant'""")
def q_filter_ne(spark, d):
    return flt.exclude_value(fx.fx_rec(spark, d), "stage", "distant").select("subject_id", "record_id", "stage")


@register("exclude_records", fixtures=("fx_tests",), sql=f"""
SELECT * FROM fx_tests
WHERE subject_id NOT IN ({", ".join(map(str, EXCLUDED_SUBJECTS))})
  AND NOT (subject_id = {CONDITIONAL_EXCLUSION[0]}
           AND COALESCE(regexp_matches(result, '{CONDITIONAL_EXCLUSION[2]}'), false))""")
def q_exclude_records(spark, d):
    ids = literal_table(spark, [(i,) for i in EXCLUDED_SUBJECTS], "subject_id bigint")
    return flt.exclude_bad_records(fx.fx_tests(spark, d), "subject_id", ids, [CONDITIONAL_EXCLUSION])


@register("filter_not_null", fixtures=("fx_rec",), sql="""
SELECT subject_id, record_id, ecog FROM fx_rec WHERE ecog IS NOT NULL""")
def q_filter_not_null(spark, d):
    return flt.require_not_null(fx.fx_rec(spark, d), "ecog").select("subject_id", "record_id", "ecog")


@register("filter_period", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem
WHERE CAST(l_shipdate AS DATE) >= DATE '1995-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1995-12-31'""")
def q_filter_period(spark, d):
    li = flt.in_period(table(spark, d, "lineitem"), "l_shipdate", "1995-01-01", "1995-12-31")
    return li.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date"))


@register("filter_period_open", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem
WHERE CAST(l_shipdate AS DATE) < DATE '1995-03-03'""")
def q_filter_period_open(spark, d):
    li = flt.in_period(table(spark, d, "lineitem"), "l_shipdate", hi="1995-03-03", hi_open=True)
    return li.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date"))


@register("filter_lag_or_null", fixtures=("fx_entry",), sql="""
SELECT subject_id, lag FROM (
  SELECT subject_id, CAST(event_date - dx_date AS BIGINT) AS lag FROM fx_entry) t
WHERE lag >= 10 OR lag IS NULL""")
def q_filter_lag(spark, d):
    e = fx.fx_entry(spark, d).select("subject_id", D.days_between("dx_date", "event_date").alias("lag"))
    return flt.at_least_or_null(e, "lag", 10)


@register("flag_duplicated", fixtures=("fx_rec",), sql="""
SELECT record_id, subject_id,
  ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id) > 1 AS is_dup
FROM fx_rec""")
def q_flag_duplicated(spark, d):
    r = fx.fx_rec(spark, d).select("record_id", "subject_id", "dx_date")
    return dedup.flag_duplicated(r, ["subject_id"], ["dx_date", "record_id"]).drop("dx_date")


@register("pred_in_regex", fixtures=("fx_rec",), sql="""
SELECT record_id, COALESCE(stage IN ('distant', 'regional'), false) AS stage_adv,
       COALESCE(regexp_matches(morph, 'metas'), false) AS morph_metas
FROM fx_rec""")
def q_pred_in_regex(spark, d):
    r = fx.fx_rec(spark, d)
    return r.select("record_id", isin_or_false("stage", ["distant", "regional"]).alias("stage_adv"),
                    rlike_or_false("morph", "metas").alias("morph_metas"))


# --- joins -------------------------------------------------------------------

@register("join_left_natural", fixtures=("fx_sess",), sql=f"""
WITH s AS (
  SELECT subject_id, MIN(age) AS age_first, MIN(session_date) AS date_first,
         MAX(session_date) AS date_last, CAST(COUNT(*) AS BIGINT) AS n_sessions
  FROM (SELECT DISTINCT subject_id, age, session_date FROM fx_sess) x
  WHERE session_date >= DATE '{SESS_LO}' AND session_date <= DATE '{SESS_HI}'
  GROUP BY subject_id)
SELECT o.o_orderkey AS subject_id, o.o_orderstatus, s.age_first, s.date_first, s.date_last, s.n_sessions
FROM orders o LEFT JOIN s ON o.o_orderkey IS NOT DISTINCT FROM s.subject_id""")
def q_join_left_natural(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("subject_id"), "o_orderstatus")
    s = agg.session_summary(fx.fx_sess(spark, d), "subject_id", "session_date", "age", SESS_LO, SESS_HI)
    return J.natural_join(o, s, "left")


@register("join_inner_natural", fixtures=("fx_rec",), sql="""
SELECT r.subject_id, r.record_id, r.code, c.c_mktsegment
FROM fx_rec r JOIN customer c ON r.subject_id IS NOT DISTINCT FROM c.c_custkey
WHERE c.c_acctbal > 4500""")
def q_join_inner_natural(spark, d):
    r = fx.fx_rec(spark, d).select("subject_id", "record_id", "code")
    c = (table(spark, d, "customer").filter(F.col("c_acctbal") > 4500)
         .select(F.col("c_custkey").alias("subject_id"), "c_mktsegment"))
    return J.natural_join(r, c, "inner")


@register("join_nullsafe_rejoin", fixtures=("fx_sess",), sql="""
WITH g AS (SELECT subject_id, rtx_date, CAST(COUNT(*) AS BIGINT) AS n_same
           FROM fx_sess GROUP BY subject_id, rtx_date)
SELECT s.subject_id, s.l_linenumber, s.l_partkey, s.l_suppkey, s.rtx_date, g.n_same
FROM fx_sess s JOIN g ON s.subject_id IS NOT DISTINCT FROM g.subject_id
                     AND s.rtx_date IS NOT DISTINCT FROM g.rtx_date""")
def q_join_nullsafe_rejoin(spark, d):
    s = fx.fx_sess(spark, d).select("subject_id", "l_linenumber", "l_partkey", "l_suppkey", "rtx_date")
    g = s.groupBy("subject_id", "rtx_date").agg(F.count(F.lit(1)).alias("n_same"))
    return J.join_null_safe(s, g, ["subject_id", "rtx_date"], "inner")


@register("join_preagg", sql="""
WITH l AS (SELECT l_orderkey, SUM(l_quantity) AS qty, CAST(COUNT(*) AS BIGINT) AS n_lines
           FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_custkey, l.qty, l.n_lines FROM orders o JOIN l ON o.o_orderkey = l.l_orderkey""")
def q_join_preagg(spark, d):
    li = (table(spark, d, "lineitem").groupBy("l_orderkey")
          .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines")))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(li, o.o_orderkey == li.l_orderkey, "inner").select("o_orderkey", "o_custkey", "qty", "n_lines")


@register("join_layout", sql="""
WITH o AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS subject_id, o_orderkey, o_totalprice FROM orders),
s AS (SELECT subject_id, CAST(COUNT(*) AS BIGINT) AS n_records, MAX(o_totalprice) AS top FROM o GROUP BY subject_id)
SELECT o.subject_id, o.o_orderkey, s.n_records, s.top, c.c_mktsegment AS segment
FROM o JOIN s ON o.subject_id IS NOT DISTINCT FROM s.subject_id LEFT JOIN customer c ON o.subject_id = c.c_custkey""")
def q_join_layout(spark, d):
    at = os.path.join(checkpoint_dir(spark), f"layout-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("subject_id"), "o_orderkey", "o_totalprice")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    orders = layout.write_laid_out(orders, f"{at}/orders", ["subject_id"])
    people = layout.write_laid_out(people, f"{at}/people", ["subject_id"])
    summ = layout.summary_laid_out(orders, ["subject_id"], F.count(F.lit(1)).alias("n_records"), F.max("o_totalprice").alias("top"))
    j = layout.join_laid_out(layout.join_laid_out(orders, summ, ["subject_id"], "inner"), people, ["subject_id"])
    return j.select("subject_id", "o_orderkey", "n_records", "top", "segment")
