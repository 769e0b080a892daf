"""Registered queries: scalar recodes, cohort variables, level tables (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort.functions import dates as D
from kohort.functions import recode as R
from kohort.functions import rowwise as RW
from kohort.operators import levels as LV
from kohort.operators import lookup as LK
from kohort.plans import fixtures as fx
from kohort.plans.q_aggregate import PRIORITY_LEVELS
from kohort.plans.registry import register
from kohort.sources import io
from kohort.sources.io import table

V1_SQL = ", ".join("'" + t + "'" for t in io.NA_TOKENS_V1)


@register("recode_null_prop", fixtures=("fx_flags",), sql="""
SELECT record_id, CASE WHEN co_f1 = 1 THEN 'Si' WHEN NOT (co_f1 = 1) THEN 'No' END AS f1_txt
FROM fx_flags""")
def q_recode_null_prop(spark, d):
    return fx.fx_flags(spark, d).select("record_id", R.recode2(F.col("co_f1") == 1, "Si", "No").alias("f1_txt"))


@register("recode_missing", fixtures=("fx_flags",), sql="""
SELECT record_id, CAST(CASE WHEN co_f1 IS NULL THEN 0 WHEN co_f1 = 1 THEN 1 ELSE 0 END AS BIGINT) AS f1_event
FROM fx_flags""")
def q_recode_missing(spark, d):
    return fx.fx_flags(spark, d).select(
        "record_id", R.recode2(F.col("co_f1") == 1, 1, 0, missing=0, has_missing=True)
        .cast("bigint").alias("f1_event"))


@register("recode_regex", fixtures=("fx_rec",), sql="""
SELECT record_id,
  CASE WHEN COALESCE(regexp_matches(morph, '[Mm]etas'), false) THEN 'Sólido' ELSE 'Hematológico' END AS tumour_type
FROM fx_rec""")
def q_recode_regex(spark, d):
    return fx.fx_rec(spark, d).select(
        "record_id", R.recode_regex("morph", "[Mm]etas", "Sólido", "Hematológico").alias("tumour_type"))


@register("case_map", sql="""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 'returned'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'accepted-closed'
       WHEN l_returnflag = 'A' THEN 'accepted-open'
       WHEN l_linestatus = 'O' THEN 'open' ELSE 'other' END AS label
FROM lineitem""")
def q_case_map(spark, d):
    li = table(spark, d, "lineitem")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    label = R.case_map([(rf == "R", "returned"), ((rf == "A") & (ls == "F"), "accepted-closed"),
                        (rf == "A", "accepted-open"), (ls == "O", "open")], "other")
    return li.select("l_orderkey", "l_linenumber", label.alias("label"))


@register("substr_codes", fixtures=("fx_rec",), sql="""
SELECT record_id, substring(morph, 2, 4) AS morph_code, substring(code, 1, 1) AS code_digit
FROM fx_rec""")
def q_substr_codes(spark, d):
    return fx.fx_rec(spark, d).select("record_id", R.substr_inclusive("morph", 2, 5).alias("morph_code"),
                                      R.substr_inclusive("code", 1, 1).alias("code_digit"))


@register("split_first", fixtures=("fx_rec",), sql="""
SELECT record_id,
  CASE WHEN strpos(morph, '-') > 0 THEN substring(morph, 1, strpos(morph, '-') - 1) ELSE morph END AS morph_code,
  CASE WHEN strpos(morph, '-') > 0 THEN substring(morph, strpos(morph, '-') + 1) END AS morph_desc
FROM fx_rec""")
def q_split_first(spark, d):
    head, rest = R.split_first("morph", "-")
    return fx.fx_rec(spark, d).select("record_id", head.alias("morph_code"), rest.alias("morph_desc"))


@register("title_case", sql="""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
                                  lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS name_title
FROM part""")
def q_title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", R.title_case("p_name").alias("name_title"))


@register("lenient_number", fixtures=("fx_dirty",), sql=f"""
SELECT event_id, TRY_CAST(CASE WHEN trim(raw_num) IN ({V1_SQL}) THEN NULL ELSE raw_num END AS DOUBLE) AS num
FROM fx_dirty""")
def q_lenient_number(spark, d):
    df = io.nullify_tokens(fx.fx_dirty(spark, d), io.NA_TOKENS_V1, ["raw_num"])
    return df.select("event_id", R.to_number("raw_num").alias("num"))


@register("leading_grade", fixtures=("fx_rec",), sql="""
SELECT record_id, CASE WHEN ecog_txt = 'Unknown' THEN NULL
                       WHEN NOT (ecog_txt = 'Unknown') THEN TRY_CAST(substring(ecog_txt, 1, 1) AS DOUBLE) END AS ecog_num
FROM fx_rec""")
def q_leading_grade(spark, d):
    return fx.fx_rec(spark, d).select("record_id", R.leading_grade("ecog_txt", ["Unknown"]).alias("ecog_num"))


@register("lenient_date", fixtures=("fx_dirty",), sql=f"""
SELECT event_id, COALESCE(CASE WHEN TRY_CAST(x AS DOUBLE) BETWEEN -693593.0 AND 2958465.0
                               THEN DATE '1899-12-30' + CAST(floor(TRY_CAST(x AS DOUBLE)) AS INT) END,
                          CAST(try_strptime(x, '%Y-%m-%d') AS DATE),
                          CAST(try_strptime(x, '%d/%m/%Y') AS DATE)) AS day
FROM (SELECT event_id, CASE WHEN trim(raw_date) IN ({V1_SQL}) THEN NULL ELSE raw_date END AS x FROM fx_dirty) t""")
def q_lenient_date(spark, d):
    df = io.nullify_tokens(fx.fx_dirty(spark, d), io.NA_TOKENS_V1, ["raw_date"])
    return df.select("event_id", R.to_date_lenient("raw_date").alias("day"))


@register("study_year_flag", sql="""
SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 'Si' ELSE 'No' END AS in_study_year FROM orders""")
def q_study_year_flag(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.year("o_orderdate") == 1996, "Si").otherwise("No").alias("in_study_year"))


@register("age_by_year", fixtures=("fx_rec",), sql="""
SELECT record_id, CAST(1996 - year(birth_date) AS BIGINT) AS age FROM fx_rec""")
def q_age_by_year(spark, d):
    return fx.fx_rec(spark, d).select("record_id", D.age_by_year(1996, "birth_date").alias("age"))


@register("days_between", sql="""
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS BIGINT) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_days_between(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select("l_orderkey", "l_linenumber",
                    D.days_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("days"))


@register("years_between", fixtures=("fx_rec",), sql="""
SELECT record_id, CAST(floor(CAST(dx_date - birth_date AS BIGINT) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age_dx
FROM fx_rec""")
def q_years_between(spark, d):
    return fx.fx_rec(spark, d).select("record_id", D.years_between("birth_date", "dx_date").alias("age_dx"))


def _age_band_sql(expr: str, breaks=(18, 40, 60, 80)) -> str:
    labels = R.age_band_labels(breaks)
    whens = " ".join(f"WHEN {expr} >= {b} THEN '{lab}'" for b, lab in reversed(list(zip(breaks, labels))))
    return f"CASE {whens} END"


@register("age_bands", fixtures=("fx_rec",), sql=f"""
SELECT record_id, {_age_band_sql("(1996 - year(birth_date))")} AS age_band FROM fx_rec""")
def q_age_bands(spark, d):
    return fx.fx_rec(spark, d).select("record_id", R.age_bands(D.age_by_year(1996, "birth_date")).alias("age_band"))


_FLAGS = [f"co_f{i}" for i in range(1, 7)]
_NULLCOUNT_SQL = " + ".join(f"CAST({c} IS NULL AS INT)" for c in _FLAGS)
_SUM_SQL = " + ".join(f"COALESCE({c}, 0)" for c in _FLAGS)


@register("row_null_count", fixtures=("fx_flags",), sql=f"""
SELECT record_id, CAST({_NULLCOUNT_SQL} AS BIGINT) AS n_missing FROM fx_flags""")
def q_row_null_count(spark, d):
    return fx.fx_flags(spark, d).select("record_id", RW.row_null_count(_FLAGS).alias("n_missing"))


@register("row_sum_guarded", fixtures=("fx_flags",), sql=f"""
SELECT record_id, CAST(CASE WHEN ({_NULLCOUNT_SQL}) < 6 THEN {_SUM_SQL} END AS BIGINT) AS n_present
FROM fx_flags""")
def q_row_sum(spark, d):
    return fx.fx_flags(spark, d).select("record_id", RW.row_sum(_FLAGS).cast("bigint").alias("n_present"))


@register("row_any", fixtures=("fx_flags",), sql="""
SELECT record_id, CAST(CASE WHEN co_f1 IS NULL AND co_f2 IS NULL AND co_f3 IS NULL THEN NULL
   WHEN COALESCE(co_f1, 0) + COALESCE(co_f2, 0) + COALESCE(co_f3, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS any_123
FROM fx_flags""")
def q_row_any(spark, d):
    return fx.fx_flags(spark, d).select("record_id", RW.row_any(["co_f1", "co_f2", "co_f3"]).cast("bigint").alias("any_123"))


# Count band labels of the two pipelines.
BANDS_V1 = ("Sin comorbilidades", "Una comorbilidad", "Dos o más comorbilidades")
BANDS_V2 = ("Sin comorbilidades", "Una comorbilidad", "Dos comorbilidades", "Más de dos comorbilidades")


@register("count_bands", fixtures=("fx_flags",), sql=f"""
SELECT record_id,
  CASE WHEN n = 0 THEN '{BANDS_V1[0]}' WHEN n = 1 THEN '{BANDS_V1[1]}' WHEN n > 1 THEN '{BANDS_V1[2]}'
       ELSE 'Desconocido' END AS band_v1,
  CASE WHEN n = 0 THEN '{BANDS_V2[0]}' WHEN n = 1 THEN '{BANDS_V2[1]}' WHEN n = 2 THEN '{BANDS_V2[2]}'
       WHEN n > 2 THEN '{BANDS_V2[3]}' ELSE 'Desconocido' END AS band_v2
FROM (SELECT record_id, CASE WHEN ({_NULLCOUNT_SQL}) < 6 THEN {_SUM_SQL} END AS n FROM fx_flags) t""")
def q_count_bands(spark, d):
    n = RW.row_sum(_FLAGS)
    return fx.fx_flags(spark, d).select(
        "record_id", R.count_bands(n, BANDS_V1, "Desconocido").alias("band_v1"),
        R.count_bands(n, BANDS_V2, "Desconocido").alias("band_v2"))


# Brand -> group lookup (12 of the 25 brands; the rest are "other").
BRAND_GROUPS = [
    ("Brand#11", "group A"), ("Brand#12", "group A"), ("Brand#13", "group A"),
    ("Brand#21", "group B"), ("Brand#22", "group B"), ("Brand#23", "group B"),
    ("Brand#31", "group C"), ("Brand#32", "group C"),
    ("Brand#1", "group D"), ("Brand#2", "group D"), ("Brand#3", "group E"), ("Brand#4", "group F"),
]
_BRAND_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in BRAND_GROUPS)


@register("code_lookup", sql=f"""
WITH lk(code, label) AS (VALUES {_BRAND_VALUES})
SELECT p_partkey, p_brand, COALESCE(lk.label, 'other') AS brand_group
FROM part LEFT JOIN lk ON p_brand = lk.code""")
def q_code_lookup(spark, d):
    lk = LK.literal_table(spark, BRAND_GROUPS, "code string, label string")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return LK.code_to_group(p, "p_brand", lk, "brand_group", "other")


# Substring rules of the name lookup, first match wins.
NAME_RULES = [("ring", "jewel"), ("widget|gizmo", "device"), ("bolt|gear", "hardware")]


@register("code_lookup_regex", sql="""
SELECT p_partkey, CASE WHEN COALESCE(regexp_matches(p_name, 'ring'), false) THEN 'jewel'
                       WHEN COALESCE(regexp_matches(p_name, 'widget|gizmo'), false) THEN 'device'
                       WHEN COALESCE(regexp_matches(p_name, 'bolt|gear'), false) THEN 'hardware'
                       ELSE 'other' END AS name_group
FROM part""")
def q_code_lookup_regex(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", LK.code_to_group_regex("p_name", NAME_RULES, "other").alias("name_group"))


@register("code_lookup_substring", sql="""
WITH word AS (SELECT item_id, unnest(string_split(text, ' ')) AS pattern FROM benchmark),
rule AS (SELECT pattern, MIN(item_id) AS label FROM word WHERE length(pattern) >= 6 GROUP BY pattern),
hit AS (SELECT d.text, MIN({'pattern': r.pattern, 'label': r.label}) AS first
        FROM (SELECT DISTINCT text FROM documents) d JOIN rule r ON contains(d.text, r.pattern) GROUP BY d.text)
SELECT d.doc_id, COALESCE(CAST(hit.first.label AS VARCHAR), 'none') AS item
FROM documents d LEFT JOIN hit ON d.text = hit.text""")
def q_code_lookup_substring(spark, d):
    word = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("pattern"))
    rules = (word.filter(F.length("pattern") >= 6).groupBy("pattern")
             .agg(F.min("item_id").cast("string").alias("label")).withColumn("rule_order", F.col("pattern")))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return LK.substring_rules(docs, "text", rules, "item", "none").select("doc_id", "item")


# Cell patches (key, column, value, only_if_null) and the nulling bound.
PATCHES = [
    (4, "dx_date", "1996-09-10", False), (5, "dx_date", "1996-09-19", False),
    (6, "dx_date", "1996-10-14", False), (7, "dx_date", "1996-12-10", False),
    (11, "stage", "local", True), (22, "stage", "local", True), (3, "stage", "local", True),
]
PATCH_NULL_AFTER = "1998-06-30"


@register("apply_patches", fixtures=("fx_rec",), sql=f"""
SELECT record_id,
  CASE WHEN record_id = 4 THEN DATE '1996-09-10' WHEN record_id = 5 THEN DATE '1996-09-19'
       WHEN record_id = 6 THEN DATE '1996-10-14' WHEN record_id = 7 THEN DATE '1996-12-10'
       WHEN dx_date > DATE '{PATCH_NULL_AFTER}' THEN NULL ELSE dx_date END AS dx_date,
  CASE WHEN record_id IN (11, 22, 3) THEN COALESCE(stage, 'local') ELSE stage END AS stage
FROM fx_rec""")
def q_apply_patches(spark, d):
    r = fx.fx_rec(spark, d).select("record_id", "dx_date", "stage")
    rules = {"dx_date": F.col("dx_date") > F.lit(PATCH_NULL_AFTER).cast("date")}
    return LK.apply_patches(r, "record_id", LK.patch_table(spark, PATCHES), rules,
                            columns=sorted({c for _, c, _, _ in PATCHES}))


# Treatment classes of the two pipelines.
TREAT_LABELS = ("Quimioterapia y radioterapia", "Quimioterapia", "Radioterapia", "Ninguno")


@register("two_flag_class", fixtures=("fx_flags",), sql=f"""
SELECT record_id,
  CASE WHEN a = 'Si' AND b = 'Si' THEN '{TREAT_LABELS[0]}' WHEN a = 'Si' AND b = 'No' THEN '{TREAT_LABELS[1]}'
       WHEN a = 'No' AND b = 'Si' THEN '{TREAT_LABELS[2]}' ELSE 'Ninguno' END AS cls_v1,
  CASE WHEN a = 'Si' AND b = 'Si' THEN '{TREAT_LABELS[0]}' WHEN a = 'Si' AND b = 'No' THEN '{TREAT_LABELS[1]}'
       WHEN a = 'No' AND b = 'Si' THEN '{TREAT_LABELS[2]}' WHEN a = 'No' AND b = 'No' THEN '{TREAT_LABELS[3]}' END AS cls_v2
FROM (SELECT record_id,
        CASE WHEN co_f1 = 1 THEN 'Si' WHEN NOT (co_f1 = 1) THEN 'No' END AS a,
        CASE WHEN co_f2 = 1 THEN 'Si' WHEN NOT (co_f2 = 1) THEN 'No' END AS b FROM fx_flags) t""")
def q_two_flag_class(spark, d):
    f = fx.fx_flags(spark, d).select(
        "record_id", R.recode2(F.col("co_f1") == 1, "Si", "No").alias("a"),
        R.recode2(F.col("co_f2") == 1, "Si", "No").alias("b"))
    v1 = R.two_flag_class("a", "b", labels=TREAT_LABELS, default="Ninguno")
    v2 = R.two_flag_class("a", "b", labels=TREAT_LABELS, default=None)
    return f.select("record_id", v1.alias("cls_v1"), v2.alias("cls_v2"))


@register("text_flag_include_exclude", sql="""
SELECT doc_id, COALESCE(regexp_matches(text, '(?i)licen[cs]e'), false)
               AND NOT COALESCE(regexp_matches(text, 'Apache'), false) AS flag
FROM documents""")
def q_text_flag(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", R.text_flag(["text"], "(?i)licen[cs]e", "Apache").alias("flag"))


@register("severity_kleene", fixtures=("fx_rec",), sql="""
SELECT record_id,
  CASE WHEN (stage = 'distant' OR m OR ecog > 1) THEN 'Grave'
       WHEN NOT (stage = 'distant' OR m OR ecog > 1) THEN 'Leve' END AS severity
FROM (SELECT *, COALESCE(regexp_matches(morph, 'metas'), false)
                AND NOT COALESCE(regexp_matches(morph, 'inc'), false) AS m FROM fx_rec) t""")
def q_severity(spark, d):
    r = fx.fx_rec(spark, d)
    m = R.text_flag(["morph"], "metas", "inc")
    sev = R.severity([F.col("stage") == "distant", m, F.col("ecog") > 1])
    return r.select("record_id", sev.alias("severity"))


@register("event_in_period", fixtures=("fx_rec",), sql="""
SELECT record_id, CAST(ev AS BIGINT) AS event_study,
       CASE WHEN ev = 1 THEN dx_date END AS event_date_study
FROM (SELECT record_id, dx_date,
        CASE WHEN COALESCE(stage = 'distant' AND year(dx_date) = 1996, false) THEN 1 ELSE 0 END AS ev
      FROM fx_rec) t""")
def q_event_in_period(spark, d):
    r = fx.fx_rec(spark, d)
    ev = D.in_year_flag(F.col("stage") == "distant", "dx_date", 1996)
    return r.select("record_id", ev.cast("bigint").alias("event_study"),
                    F.when(ev == 1, F.col("dx_date")).alias("event_date_study"))


STUDY_START, STUDY_END = "1996-03-03", "1996-12-31"


def entry_exit(spark, d):
    """Cohort entry/exit on FX-ENTRY (v2 pipeline dates)."""
    e = fx.fx_entry(spark, d)
    ev = D.in_year_flag(F.col("event_date").isNotNull(), "event_date", 1996)
    died = D.in_year_flag(F.col("death_date").isNotNull(), "death_date", 1996)
    return e.select(
        "subject_id", "dx_date",
        D.clamp_entry("dx_date", STUDY_START).alias("entry_date"),
        D.cohort_exit(ev, "event_date", died, "death_date", STUDY_END).alias("exit_date"),
        ev.cast("bigint").alias("event"), died.cast("bigint").alias("died"))


ENTRY_EXIT_SQL = f"""
WITH ee AS (
  SELECT subject_id, dx_date,
    CASE WHEN dx_date < DATE '{STUDY_START}' THEN DATE '{STUDY_START}' WHEN dx_date >= DATE '{STUDY_START}' THEN dx_date END AS entry_date,
    CASE WHEN ev = 0 AND died = 0 THEN DATE '{STUDY_END}' WHEN ev = 0 AND died = 1 THEN death_date
         WHEN ev = 1 THEN event_date END AS exit_date,
    CAST(ev AS BIGINT) AS event, CAST(died AS BIGINT) AS died
  FROM (SELECT *, CASE WHEN COALESCE(event_date IS NOT NULL AND year(event_date) = 1996, false) THEN 1 ELSE 0 END AS ev,
                  CASE WHEN COALESCE(death_date IS NOT NULL AND year(death_date) = 1996, false) THEN 1 ELSE 0 END AS died
        FROM fx_entry) t)"""


@register("cohort_entry", fixtures=("fx_entry",), sql=ENTRY_EXIT_SQL + """
SELECT subject_id, entry_date FROM ee""")
def q_cohort_entry(spark, d):
    return entry_exit(spark, d).select("subject_id", "entry_date")


@register("cohort_exit", fixtures=("fx_entry",), sql=ENTRY_EXIT_SQL + """
SELECT subject_id, exit_date, event, died FROM ee""")
def q_cohort_exit(spark, d):
    return entry_exit(spark, d).select("subject_id", "exit_date", "event", "died")


SURV_ORIGIN, SURV_END = "1995-01-01", "1995-12-31"


def surv_small(spark, d):
    """FX-SURV as (subject, grp, exposed, time, event)."""
    s = fx.fx_surv_dates(spark, d)
    ev = F.when(F.col("event_date").isNotNull(), 1).otherwise(0)
    return s.select("subject_id", "grp", "exposed",
                    D.time_to_event(ev, "event_date", SURV_ORIGIN, SURV_END).alias("time"),
                    ev.cast("bigint").alias("event"))


SURV_SMALL_SQL = f"""
surv AS (
  SELECT subject_id, grp, exposed,
    CAST(CASE WHEN event_date IS NULL THEN DATE '{SURV_END}' - DATE '{SURV_ORIGIN}'
              ELSE event_date - DATE '{SURV_ORIGIN}' END AS BIGINT) AS time,
    CAST(CASE WHEN event_date IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS event
  FROM fx_surv_dates)"""


@register("time_to_event", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + """
SELECT subject_id, time, event FROM surv""")
def q_time_to_event(spark, d):
    return surv_small(spark, d).select("subject_id", "time", "event")


@register("levels_sorted", sql="""
SELECT level, CAST(ROW_NUMBER() OVER (ORDER BY level) AS BIGINT) AS ord
FROM (SELECT DISTINCT o_orderstatus AS level FROM orders WHERE o_orderstatus IS NOT NULL) t""")
def q_levels_sorted(spark, d):
    return LV.levels_from(table(spark, d, "orders"), "o_orderstatus")


@register("levels_by_freq", sql="""
SELECT level, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, level) AS BIGINT) AS ord
FROM (SELECT o_custkey % 7 AS k, CAST(o_custkey % 7 AS VARCHAR) AS level, COUNT(*) AS n FROM orders GROUP BY 1, 2) t""")
def q_levels_by_freq(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("k"))
    return LV.levels_by_freq(o, "k")


@register("levels_relevel", sql="""
WITH f AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS level, COUNT(*) AS n FROM orders GROUP BY 1),
o AS (SELECT level, ROW_NUMBER() OVER (ORDER BY n DESC, level) AS ord FROM f)
SELECT level, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN level = '3' THEN -1 WHEN level = '0' THEN 1000000 ELSE ord END) AS BIGINT) AS ord
FROM o""")
def q_levels_relevel(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("k"))
    return LV.relevel(LV.levels_by_freq(o, "k"), first=["3"], last=["0"])


@register("levels_drop_unused", sql=f"""
WITH lv(level, ord) AS (VALUES {", ".join(f"('{lv}', {i + 1})" for i, lv in enumerate(PRIORITY_LEVELS))})
SELECT level, CAST(ROW_NUMBER() OVER (ORDER BY ord) AS BIGINT) AS ord
FROM lv WHERE level IN (SELECT o_orderpriority FROM orders)""")
def q_levels_drop_unused(spark, d):
    lv = LV.levels_literal(spark, PRIORITY_LEVELS)
    return LV.drop_unused_levels(lv, table(spark, d, "orders"), "o_orderpriority")


@register("patch_where_code", fixtures=("fx_rec",), sql="""
SELECT record_id, CASE WHEN code = '3-MEDIUM' THEN 'blood' ELSE 'solid' END AS kind,
  CASE WHEN subject_id = 7 AND stage IS NULL THEN 'local' ELSE stage END AS stage FROM fx_rec""")
def q_patch_where_code(spark, d):
    r = fx.fx_rec(spark, d).select("record_id", "subject_id", "code", "stage", F.lit("solid").alias("kind"))
    r = LK.patch_where(r, [("kind", F.col("code") == "3-MEDIUM", "blood"),
                           ("stage", (F.col("subject_id") == 7) & F.col("stage").isNull(), "local")])
    return r.select("record_id", "kind", "stage")
