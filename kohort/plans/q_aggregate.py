"""Registered queries: aggregation, de-duplication, reshaping (E, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort.operators import aggregate as agg
from kohort.operators import dedup
from kohort.plans import fixtures as fx
from kohort.plans.registry import register
from kohort.sources.io import table

# Study period of the session fixture (analogue of the 2020 treatment year).
SESS_LO, SESS_HI = "1995-01-01", "1996-12-31"


@register("session_summary", fixtures=("fx_sess",), sql=f"""
SELECT subject_id, MIN(age) AS age_first, MIN(session_date) AS date_first,
       MAX(session_date) AS date_last, CAST(COUNT(*) AS BIGINT) AS n_sessions
FROM (SELECT DISTINCT subject_id, age, session_date FROM fx_sess) s
WHERE session_date >= DATE '{SESS_LO}' AND session_date <= DATE '{SESS_HI}'
GROUP BY subject_id""")
def q_session_summary(spark, d):
    return agg.session_summary(fx.fx_sess(spark, d), "subject_id", "session_date", "age",
                               SESS_LO, SESS_HI)


@register("session_summary_strict", fixtures=("fx_sess",), sql=f"""
SELECT subject_id, CASE WHEN COUNT(age) = COUNT(*) THEN MIN(age) END AS age_first,
       MIN(session_date) AS date_first, MAX(session_date) AS date_last,
       CAST(COUNT(*) AS BIGINT) AS n_sessions
FROM (SELECT DISTINCT subject_id, age, session_date FROM fx_sess) s
WHERE session_date >= DATE '{SESS_LO}' AND session_date <= DATE '{SESS_HI}'
GROUP BY subject_id""")
def q_session_summary_strict(spark, d):
    return agg.session_summary_strict(fx.fx_sess(spark, d), "subject_id", "session_date", "age",
                                      SESS_LO, SESS_HI)


@register("agg_strict_max", fixtures=("fx_rec",), sql="""
SELECT subject_id, CASE WHEN COUNT(ecog) = COUNT(*) THEN MAX(ecog) END AS ecog_max,
       MAX(ecog) AS ecog_max_narm
FROM fx_rec GROUP BY subject_id""")
def q_agg_strict_max(spark, d):
    from kohort.functions.nulls import strict_max
    return fx.fx_rec(spark, d).groupBy("subject_id").agg(
        strict_max("ecog").alias("ecog_max"), F.max("ecog").alias("ecog_max_narm"))


COLLAPSE_SQL = """
WITH r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id) AS rn_a,
         ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date DESC NULLS FIRST, record_id DESC) AS rn_d,
         COUNT(*) OVER (PARTITION BY subject_id) AS n
  FROM fx_rec),
c AS (
  SELECT subject_id, CAST(MAX(n) AS BIGINT) AS n_records,
    MAX(CASE WHEN rn_a = 1 THEN code END) AS code_1,
    CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN code END) END AS code_2,
    MAX(CASE WHEN rn_a = 1 THEN morph END) AS morph_1,
    CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN morph END) END AS morph_2,
    MAX(CASE WHEN rn_a = 1 THEN dx_date END) AS dx_date_1,
    CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN dx_date END) END AS dx_date_2,
    MAX(CASE WHEN rn_a = 1 THEN stage END) AS stage,
    MAX(CASE WHEN rn_a = 1 THEN birth_date END) AS birth_date,
    CASE WHEN COUNT(ecog) = COUNT(*) THEN MAX(ecog) END AS ecog
  FROM r GROUP BY subject_id)"""


def collapse_rec(spark, d):
    """FX-REC collapsed to one row per subject (first/last tumour)."""
    return agg.collapse_multi(fx.fx_rec(spark, d), ["subject_id"], ["code", "morph", "dx_date"],
                              ["dx_date", "record_id"], first_only=["stage", "birth_date"],
                              strict_max_cols=["ecog"])


@register("collapse_multi_record", fixtures=("fx_rec",), sql=COLLAPSE_SQL + """
SELECT *, CASE WHEN code_2 IS NOT NULL THEN 'Si' ELSE 'No' END AS has_second FROM c""")
def q_collapse_multi_record(spark, d):
    c = collapse_rec(spark, d)
    return c.withColumn("has_second", F.when(F.col("code_2").isNotNull(), "Si").otherwise("No"))


@register("agg_mean_indicators", fixtures=("fx_flags",), sql="SELECT subject_id, " + ", ".join(
    f"ROUND(AVG(co_f{i}), 6) AS co_f{i}" for i in range(1, 7)) + " FROM fx_flags GROUP BY subject_id")
def q_agg_mean_indicators(spark, d):
    m = agg.mean_indicators(fx.fx_flags(spark, d), ["subject_id"], fx.FLAG_COLS)
    return m.select("subject_id", *[F.round(c, 6).alias(c) for c in fx.FLAG_COLS])


@register("distinct_sessions", fixtures=("fx_sess",), sql="""
SELECT DISTINCT subject_id, age, session_date FROM fx_sess""")
def q_distinct_sessions(spark, d):
    return agg.distinct_rows(fx.fx_sess(spark, d), ["subject_id", "age", "session_date"])


@register("value_counts", sql="""
SELECT p_type AS level, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY p_type""")
def q_value_counts(spark, d):
    return agg.value_counts(table(spark, d, "part"), "p_type")


# Level table of the priority column, with one unused level.
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-UNUSED"]
_PRIO_VALUES = ", ".join(f"('{lv}', {i + 1})" for i, lv in enumerate(PRIORITY_LEVELS))


@register("value_counts_levels", sql=f"""
WITH lv(level, ord) AS (VALUES {_PRIO_VALUES}),
cnt AS (SELECT o_orderpriority AS level, COUNT(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT COALESCE(lv.level, cnt.level) AS level, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n,
       CAST(lv.ord AS BIGINT) AS ord
FROM lv FULL JOIN cnt ON lv.level IS NOT DISTINCT FROM cnt.level""")
def q_value_counts_levels(spark, d):
    from kohort.operators.levels import levels_literal
    return agg.value_counts(table(spark, d, "orders"), "o_orderpriority",
                            levels=levels_literal(spark, PRIORITY_LEVELS))


@register("spread_first_two", fixtures=("fx_rec",), sql="""
WITH r AS (SELECT subject_id, dx_date,
             ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id) AS rn
           FROM fx_rec)
SELECT subject_id, MAX(CASE WHEN rn = 1 THEN dx_date END) AS dx_date_1,
       MAX(CASE WHEN rn = 2 THEN dx_date END) AS dx_date_2
FROM r WHERE rn <= 2 GROUP BY subject_id""")
def q_spread_first_two(spark, d):
    return agg.spread_nth(fx.fx_rec(spark, d), ["subject_id"], "dx_date", ["dx_date", "record_id"], 2)


@register("one_per_subject", fixtures=("fx_tests",), sql="""
SELECT event_id, subject_id, test_date, result, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id
            ORDER BY result DESC NULLS LAST, test_date DESC NULLS LAST, event_id) AS rn
  FROM fx_tests) t WHERE rn = 1""")
def q_one_per_subject(spark, d):
    return dedup.first_per_key(fx.fx_tests(spark, d), ["subject_id"],
                               [("result", "desc"), ("test_date", "desc"), "event_id"])


# Subjects whose tumour type is overridden, and the label.
TYPE_OVERRIDES = [(7, "override"), (11, "override")]


@register("agg_type_or_both", fixtures=("fx_rec",), sql=f"""
WITH g AS (SELECT subject_id,
             CASE WHEN MIN(code) <> MAX(code) THEN 'both' ELSE MIN(code) END AS code
           FROM fx_rec GROUP BY subject_id),
ov(subject_id, label) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in TYPE_OVERRIDES)})
SELECT g.subject_id, COALESCE(ov.label, g.code) AS code
FROM g LEFT JOIN ov ON g.subject_id = ov.subject_id""")
def q_agg_type_or_both(spark, d):
    from kohort.operators.lookup import literal_table
    ov = literal_table(spark, TYPE_OVERRIDES, "subject_id bigint, label string")
    return agg.type_or_both(fx.fx_rec(spark, d), ["subject_id"], "code", overrides=ov)


@register("first_per_key", fixtures=("fx_tests",), sql="""
SELECT event_id, subject_id, test_date, result, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY test_date NULLS LAST, event_id) AS rn
  FROM fx_tests) t WHERE rn = 1""")
def q_first_per_key(spark, d):
    return dedup.first_per_key(fx.fx_tests(spark, d), ["subject_id"], ["test_date", "event_id"])


@register("first_per_many_keys", fixtures=("fx_tests",), sql="""
SELECT event_id, subject_id, test_date, result, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id, result ORDER BY test_date NULLS LAST, event_id) AS rn
  FROM fx_tests) t WHERE rn = 1""")
def q_first_per_many_keys(spark, d):
    return dedup.first_per_key(fx.fx_tests(spark, d), ["subject_id", "result"], ["test_date", "event_id"])


@register("row_number_col", sql="""
SELECT o_orderkey, o_custkey,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS BIGINT) AS n
FROM orders""")
def q_row_number_col(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dedup.row_number_col(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]) \
        .select("o_orderkey", "o_custkey", F.col("n").cast("bigint"))


@register("first_last_over", fixtures=("fx_rec",), sql="""
SELECT record_id, subject_id, code,
  FIRST_VALUE(code) OVER w AS code_first, LAST_VALUE(code) OVER w AS code_last
FROM fx_rec
WINDOW w AS (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q_first_last_over(spark, d):
    r = fx.fx_rec(spark, d).select("record_id", "subject_id", "code", "dx_date")
    return dedup.first_last_over(r, ["subject_id"], ["code"], ["dx_date", "record_id"]).drop("dx_date")


@register("sort_nulls_last", fixtures=("fx_rec",), sql="""
SELECT subject_id, record_id, ecog, stage,
  CAST(ROW_NUMBER() OVER (PARTITION BY subject_id
       ORDER BY ecog DESC NULLS LAST, stage NULLS LAST, record_id) AS BIGINT) AS rn
FROM fx_rec""")
def q_sort_nulls_last(spark, d):
    r = fx.fx_rec(spark, d).select("subject_id", "record_id", "ecog", "stage")
    return dedup.row_number_col(r, ["subject_id"], [("ecog", "desc"), "stage", "record_id"], "rn") \
        .withColumn("rn", F.col("rn").cast("bigint"))


@register("top_k_values", sql="""
SELECT p_name AS value, CAST(COUNT(*) AS BIGINT) AS n FROM part
GROUP BY p_name ORDER BY n DESC, value LIMIT 30""")
def q_top_k_values(spark, d):
    return agg.top_values(table(spark, d, "part"), "p_name", 30)


@register("arrange_rows", fixtures=("fx_rec",), sql="""
SELECT subject_id, record_id, ecog, stage FROM fx_rec ORDER BY ecog DESC NULLS LAST, stage NULLS LAST, record_id""")
def q_arrange_rows(spark, d):
    r = fx.fx_rec(spark, d).select("subject_id", "record_id", "ecog", "stage")
    return dedup.arrange(r, [("ecog", "desc"), "stage", "record_id"])


@register("number_null_keys", fixtures=("fx_rec",), sql="""
SELECT stage, record_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY stage ORDER BY code DESC NULLS LAST, record_id) AS BIGINT) AS rn,
  ROW_NUMBER() OVER (PARTITION BY stage ORDER BY code DESC NULLS LAST, record_id) > 1 AS is_dup
FROM fx_rec""")
def q_number_null_keys(spark, d):
    """NULL keys are one group; text order, descending."""
    r = fx.fx_rec(spark, d).select("stage", "code", "record_id")
    out = dedup.row_number_col(r, ["stage"], [("code", "desc"), "record_id"], "rn")
    return out.select("stage", "record_id", F.col("rn").cast("bigint"), (F.col("rn") > 1).alias("is_dup"))
