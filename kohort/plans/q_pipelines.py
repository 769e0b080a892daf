"""Registered queries: end-to-end jobs."""

from __future__ import annotations

from kohort.plans import pipelines as P
from kohort.plans.fixtures import SQL as FX
from kohort.plans.q_columns import V1_SQL
from kohort.plans.q_filters import EXCLUDED_SUBJECTS
from kohort.plans.q_survival import rounded
from kohort.plans.registry import register

_FL = [f"co_f{i}" for i in range(1, 7)]
_LO, _HI = P.SESSION_PERIOD


def _band(n: str) -> str:
    b = P.COMORB_BANDS
    return (f"CASE WHEN {n} = 0 THEN '{b[0]}' WHEN {n} = 1 THEN '{b[1]}' WHEN {n} > 1 THEN '{b[2]}' "
            f"ELSE 'unknown' END")


def _metas(c: str) -> str:
    return (f"(COALESCE(regexp_matches({c}, 'metas'), false) AND NOT COALESCE(regexp_matches({c}, 'inc'), false))")


def _token(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ({V1_SQL}) THEN NULL ELSE {c} END"


def _title(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


def _treat_ctes(age: str, rtx_filter: str) -> str:
    """Treatment table ``tr``; ``age`` is the youngest age's expression."""
    both, chemo, radio, none = P.TREATMENTS
    patched = " ".join(f"WHEN b.subject_id = {k} THEN DATE '{v}'" for k, _, v, _ in P.RTX_PATCHES)
    return f"""
sess AS (SELECT subject_id, {age} AS age_first, MIN(session_date) AS date_first,
                MAX(session_date) AS date_last, CAST(COUNT(*) AS BIGINT) AS n_sessions
         FROM (SELECT DISTINCT o.o_custkey AS subject_id, s.age, s.session_date
               FROM fx_sess s JOIN orders o ON s.subject_id = o.o_orderkey) x
         WHERE session_date >= DATE '{_LO}' AND session_date <= DATE '{_HI}' GROUP BY subject_id),
rx AS (SELECT o.o_custkey AS subject_id, MIN(s.rtx_date) AS rtx_date
       FROM fx_sess s JOIN orders o ON s.subject_id = o.o_orderkey
       WHERE s.rtx_date IS NOT NULL{rtx_filter} GROUP BY o.o_custkey),
tb AS (SELECT subject_id, {_title("chemo")} AS chemo, {_title("radio")} AS radio FROM (
         SELECT subject_id, {_token("chemo")} AS chemo, {_token("radio")} AS radio,
                ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY record_id) AS rn FROM fx_treat) t WHERE rn = 1),
tr AS (SELECT b.subject_id, b.chemo, b.radio, s.age_first, s.date_first, s.date_last, s.n_sessions,
              CASE {patched} WHEN rx.rtx_date > DATE '{P.RTX_LIMIT}' THEN NULL ELSE rx.rtx_date END AS rtx_date,
              CASE WHEN b.chemo = 'Si' AND b.radio = 'Si' THEN '{both}' WHEN b.chemo = 'Si' AND b.radio = 'No' THEN '{chemo}'
                   WHEN b.chemo = 'No' AND b.radio = 'Si' THEN '{radio}' ELSE '{none}' END AS treat_class
       FROM tb b LEFT JOIN sess s ON b.subject_id = s.subject_id LEFT JOIN rx ON b.subject_id = rx.subject_id)"""


REGISTRY_CTES = ",\n".join(f"{n} AS ({FX[n].strip()})" for n in (
    "fx_rec", "fx_sess", "fx_flags", "fx_tests", "fx_raw", "fx_treat")) + f""",
raw AS (SELECT TRY_CAST({_token("id_pte")} AS BIGINT) AS subject_id, TRY_CAST({_token("num_registro")} AS BIGINT) AS record_id,
               CASE WHEN sex = 'Mujer' THEN 'Femenino' WHEN NOT (sex = 'Mujer') THEN 'Masculino' END AS sex
        FROM (SELECT *, {_token("ptesxn_x")} AS sex, {_token("compn")} AS behaviour FROM fx_raw) x
        WHERE behaviour <> 'Benigno'),
rec0 AS (SELECT fx_rec.*, raw.sex,
          CASE WHEN code = '{P.BLOOD_CODE}' THEN '{P.BLOOD}'
               WHEN COALESCE(regexp_matches(morph, '[Mm]etas'), false) THEN '{P.SOLID}' ELSE '{P.BLOOD}' END AS tumour_type,
          substr(split_part(morph, '-', 1), 2, 4) AS morph_code,
          CASE WHEN ecog_txt = 'Unknown' THEN NULL
               WHEN NOT (ecog_txt = 'Unknown') THEN TRY_CAST(substring(ecog_txt, 1, 1) AS DOUBLE) END AS ecog_num,
          ROW_NUMBER() OVER (PARTITION BY fx_rec.subject_id, birth_date, sex, code, stage, ecog_txt, morph
                             ORDER BY dx_date DESC NULLS LAST, fx_rec.record_id) AS rn_dup
        FROM fx_rec JOIN raw ON fx_rec.subject_id = raw.subject_id AND fx_rec.record_id = raw.record_id
        WHERE fx_rec.subject_id NOT IN ({", ".join(map(str, EXCLUDED_SUBJECTS))})),
rec AS (SELECT * REPLACE (CASE WHEN subject_id = {P.STAGE_FILL_SUBJECT} AND stage IS NULL THEN 'local' ELSE stage END AS stage)
        FROM rec0 WHERE rn_dup = 1),
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id) AS rn_a,
              ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date DESC NULLS FIRST, record_id DESC) AS rn_d,
              COUNT(*) OVER (PARTITION BY subject_id) AS n FROM rec),
dates AS (SELECT subject_id, birth_date, MAX(CASE WHEN rn = 1 THEN dx_date END) AS dx_1, MAX(CASE WHEN rn = 2 THEN dx_date END) AS dx_2
          FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id, birth_date ORDER BY dx_date NULLS LAST, record_id) AS rn
                FROM fx_rec) x GROUP BY subject_id, birth_date
          HAVING MAX(CASE WHEN rn = 1 THEN dx_date END) < DATE '{P.DX_LIMIT}'),
col AS (SELECT subject_id, CAST(MAX(n) AS BIGINT) AS n_records,
          MAX(CASE WHEN rn_a = 1 THEN code END) AS code_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN code END) END AS code_2,
          MAX(CASE WHEN rn_a = 1 THEN morph END) AS morph_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN morph END) END AS morph_2,
          MAX(CASE WHEN rn_a = 1 THEN morph_code END) AS morph_code_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN morph_code END) END AS morph_code_2,
          MAX(CASE WHEN rn_a = 1 THEN stage END) AS stage,
          CASE WHEN subject_id IN ({", ".join(map(str, P.BOTH_TYPES_SUBJECTS))}) THEN '{P.BOTH}'
               ELSE MAX(CASE WHEN rn_a = 1 THEN tumour_type END) END AS tumour_type,
          MAX(CASE WHEN rn_a = 1 THEN birth_date END) AS birth_date,
          MAX(CASE WHEN rn_a = 1 THEN sex END) AS sex,
          CASE WHEN COUNT(ecog_num) = COUNT(*) THEN MAX(ecog_num) END AS ecog_num
        FROM rr GROUP BY subject_id),
{_treat_ctes("MIN(age)", "").strip()},
fl0 AS (SELECT subject_id, {", ".join(f"CAST(ceil(AVG({c})) AS BIGINT) AS {c}" for c in _FL)}
        FROM fx_flags GROUP BY subject_id),
fl AS (SELECT *, CASE WHEN {" AND ".join(f"{c} IS NULL" for c in _FL)} THEN NULL
                      ELSE {" + ".join(f"COALESCE({c}, 0)" for c in _FL)} END AS com_n,
              CAST({" + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _FL)} AS BIGINT) AS com_missing FROM fl0),
ts AS (SELECT subject_id, test_date, result FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id
                   ORDER BY result DESC NULLS LAST, test_date DESC NULLS LAST, event_id) AS rn
         FROM fx_tests) t WHERE rn = 1),
lk(code, label) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.CODE_GROUPS)}),
j AS (SELECT col.*, tr.chemo, tr.radio, tr.treat_class, tr.rtx_date, tr.age_first, tr.date_first, tr.date_last, tr.n_sessions,
             dates.dx_1, dates.dx_2,
             {", ".join(f"CASE WHEN fl.{c} = 1 THEN 'Si' WHEN fl.{c} <> 1 THEN 'No' END AS {c}" for c in _FL)},
             fl.com_n, fl.com_missing, {_band("fl.com_n")} AS com_band,
             ts.test_date, ts.result, COALESCE(lk.label, 'other') AS code_group,
             CAST({P.REF_YEAR} - year(col.birth_date) AS BIGINT) AS age,
             CAST(floor(CAST(dates.dx_1 - col.birth_date AS BIGINT) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age_dx,
             CASE WHEN col.code_2 IS NOT NULL THEN 'Si' ELSE 'No' END AS has_second,
             CASE WHEN col.stage = 'distant' THEN 'Si' WHEN {_metas("col.morph_1")} THEN 'Si'
                  WHEN {_metas("col.morph_2")} THEN 'Si' ELSE 'No' END AS metastasis,
             CAST(CASE WHEN COALESCE(ts.result = 'purchase' AND year(ts.test_date) = {P.TEST_YEAR}, false)
                       THEN 1 ELSE 0 END AS BIGINT) AS event
      FROM col JOIN dates ON col.subject_id = dates.subject_id AND col.birth_date = dates.birth_date
               JOIN tr ON col.subject_id = tr.subject_id
               LEFT JOIN fl ON col.subject_id = fl.subject_id
               LEFT JOIN ts ON col.subject_id = ts.subject_id
               LEFT JOIN lk ON col.code_1 = lk.code),
reg AS (SELECT subject_id, sex, birth_date, age,
          CASE WHEN age >= 80 THEN '80+' WHEN age >= 60 THEN '60-79' WHEN age >= 40 THEN '40-59'
               WHEN age >= 18 THEN '18-39' END AS age_cat,
          age_dx, {", ".join(_FL)}, com_n, com_missing, com_band, code_1, morph_1, morph_code_1, dx_1, code_2, morph_2,
          morph_code_2, dx_2, n_records, code_group, chemo, radio, treat_class, rtx_date, stage, tumour_type, ecog_num, has_second, metastasis,
          CASE WHEN (has_second = 'Si' OR metastasis = 'Si' OR COALESCE(stage IN ('distant', 'regional'), false)
                     OR ecog_num > 1) THEN 'Grave'
               WHEN NOT (has_second = 'Si' OR metastasis = 'Si' OR COALESCE(stage IN ('distant', 'regional'), false)
                     OR ecog_num > 1) THEN 'Leve' END AS severity,
          age_first, date_first, date_last, n_sessions, test_date, result, event,
          CASE WHEN event = 1 THEN CAST(test_date - dx_1 AS BIGINT) END AS days_dx_event,
          CASE WHEN event = 1 THEN CAST(test_date - date_last AS BIGINT) END AS days_chemo_event,
          CAST(CASE WHEN event = 0 THEN DATE '{P.TEST_END}' - DATE '{P.TEST_ORIGIN}'
                    ELSE test_date - DATE '{P.TEST_ORIGIN}' END AS BIGINT) AS time
        FROM j)"""


@register("pipeline_registry", sql="WITH " + REGISTRY_CTES + "\nSELECT * FROM reg")
def q_pipeline_registry(spark, d):
    return P.clean_registry(spark, d)


_UNPIV = " UNION ALL ".join(
    f"SELECT '{g}' AS variable, CAST({g} AS VARCHAR) AS level, time, event FROM reg" for g in P.REPORT_GROUPINGS)


@register("pipeline_report", sql="WITH " + REGISTRY_CTES + f""",
surv AS (SELECT * FROM ({_UNPIV}) u WHERE level IS NOT NULL AND time IS NOT NULL AND event IS NOT NULL),
c AS (SELECT variable, level, time AS t, CAST(SUM(event) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS m
      FROM surv GROUP BY variable, level, time),
r AS (SELECT *, SUM(m) OVER (PARTITION BY variable, level ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM c),
k AS (SELECT *, PRODUCT(CASE WHEN n > 0 THEN 1 - d / n ELSE 1 END)
                  OVER (PARTITION BY variable, level ORDER BY t ROWS UNBOUNDED PRECEDING) AS surv FROM r)
SELECT variable, level, t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
       CAST(m - d AS BIGINT) AS n_censor, ROUND(surv, 6) AS surv FROM k""")
def q_pipeline_report(spark, d):
    km = P.km_many(P.clean_registry(spark, d), "time", "event", P.REPORT_GROUPINGS)
    return rounded(km.select("variable", "level", "time", "n_risk", "n_event", "n_censor", "surv"))


def _site_sql(c: str) -> str:
    return ("CASE " + " ".join(f"WHEN COALESCE(regexp_matches({c}, '{p}'), false) THEN '{lab}'"
                               for p, lab in P.V2_SITE_RULES) + " ELSE 'other' END")


def _band_v2(n: str) -> str:
    b = P.V2_BANDS
    return (f"CASE WHEN {n} = 0 THEN '{b[0]}' WHEN {n} = 1 THEN '{b[1]}' WHEN {n} = 2 THEN '{b[2]}' "
            f"WHEN {n} > 2 THEN '{b[3]}' ELSE 'Desconocido' END")


_S0, _S1 = P.V2_STUDY
REGISTRY_V2_SQL = "WITH " + ",\n".join(
    f"{n} AS ({FX[n].strip()})" for n in ("fx_rec", "fx_sess", "fx_flags", "fx_entry", "fx_treat")) + f""",
rec AS (SELECT * FROM fx_rec WHERE dx_date IS NOT NULL AND code <> '{P.V2_EXCLUDED_CODE}'
          AND subject_id NOT IN ({", ".join(map(str, EXCLUDED_SUBJECTS))})),
fl0 AS (SELECT record_id, subject_id, GREATEST(co_f1, co_f2) AS com_a, GREATEST(co_f3, co_f4) AS com_b,
               GREATEST(co_f5, co_f6) AS com_c FROM fx_flags),
fl AS (SELECT *, CASE WHEN com_a IS NULL AND com_b IS NULL AND com_c IS NULL THEN NULL
                      ELSE COALESCE(com_a, 0) + COALESCE(com_b, 0) + COALESCE(com_c, 0) END AS com_n FROM fl0),
r AS (SELECT rec.subject_id, rec.record_id, rec.dx_date, rec.birth_date, rec.code, rec.morph,
             CASE WHEN rec.subject_id = {P.V2_FILL_SUBJECT} AND rec.stage IS NULL THEN 'local'
                  WHEN rec.stage IS NULL THEN 'unknown' ELSE rec.stage END AS stage,
             CASE WHEN COALESCE(regexp_matches(rec.morph, 'metas inc'), false)
                    OR COALESCE(regexp_matches(rec.code, '^1-'), false) THEN 'Hematológico' ELSE 'Sólido' END AS tumour_type,
             CASE WHEN rec.ecog_txt = 'Unknown' THEN NULL
                  WHEN NOT (rec.ecog_txt = 'Unknown') THEN TRY_CAST(substring(rec.ecog_txt, 1, 1) AS DOUBLE) END AS ecog_num,
             fl.com_a, fl.com_b, fl.com_c, fl.com_n
      FROM rec JOIN fl ON rec.record_id = fl.record_id AND rec.subject_id = fl.subject_id),
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date NULLS LAST, record_id) AS rn_a,
              ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dx_date DESC NULLS FIRST, record_id DESC) AS rn_d,
              COUNT(*) OVER (PARTITION BY subject_id) AS n FROM r),
col AS (SELECT subject_id, CAST(MAX(n) AS BIGINT) AS n_records,
          MAX(CASE WHEN rn_a = 1 THEN code END) AS code_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN code END) END AS code_2,
          MAX(CASE WHEN rn_a = 1 THEN morph END) AS morph_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN morph END) END AS morph_2,
          MAX(CASE WHEN rn_a = 1 THEN dx_date END) AS dx_date_1,
          CASE WHEN MAX(n) > 1 THEN MAX(CASE WHEN rn_d = 1 THEN dx_date END) END AS dx_date_2,
          MAX(CASE WHEN rn_a = 1 THEN stage END) AS stage,
          MAX(CASE WHEN rn_a = 1 THEN tumour_type END) AS tumour_type,
          MAX(CASE WHEN rn_a = 1 THEN birth_date END) AS birth_date,
          CASE WHEN COUNT(ecog_num) = COUNT(*) THEN MAX(ecog_num) END AS ecog_num,
          AVG(com_a) AS com_a, AVG(com_b) AS com_b, AVG(com_c) AS com_c, AVG(com_n) AS com_n
        FROM rr GROUP BY subject_id),
{_treat_ctes("CASE WHEN COUNT(age) = COUNT(*) THEN MIN(age) END", f" AND s.rtx_date <= DATE '{P.RTX_LIMIT}'").strip()},
j AS (SELECT col.*, tr.chemo, tr.radio, tr.treat_class, tr.rtx_date, tr.age_first, tr.date_first, tr.date_last, tr.n_sessions,
             fx_entry.event_date, fx_entry.death_date,
             CAST(fx_entry.event_date - col.dx_date_1 AS BIGINT) AS lag
      FROM col JOIN tr ON col.subject_id = tr.subject_id
               LEFT JOIN fx_entry ON col.subject_id = fx_entry.subject_id),
k AS (SELECT *, CAST({P.V2_STUDY_YEAR} - year(birth_date) AS BIGINT) AS age,
        CAST(floor(CAST(dx_date_1 - birth_date AS BIGINT) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age_dx_1,
        CASE WHEN code_2 IS NOT NULL THEN 'Si' ELSE 'No' END AS has_second,
        CASE WHEN stage = 'distant' THEN 'Si' WHEN {_metas("morph_1")} THEN 'Si'
             WHEN {_metas("morph_2")} THEN 'Si' ELSE 'No' END AS metastasis,
        CAST(CASE WHEN COALESCE(event_date IS NOT NULL AND year(event_date) = {P.V2_STUDY_YEAR}, false) THEN 1 ELSE 0 END AS BIGINT) AS event_study,
        CAST(CASE WHEN COALESCE(death_date IS NOT NULL AND year(death_date) = {P.V2_STUDY_YEAR}, false) THEN 1 ELSE 0 END AS BIGINT) AS died_study,
        CAST(CASE WHEN COALESCE(event_date <= death_date AND year(death_date) = {P.V2_STUDY_YEAR}, false) THEN 1 ELSE 0 END AS BIGINT) AS died_cause_study,
        {_band_v2("com_n")} AS com_n_cat, {_site_sql("code_1")} AS loc_tumor
      FROM j WHERE lag >= {P.V2_LAG_MIN_DAYS} OR lag IS NULL)
SELECT subject_id, birth_date, age,
  CASE WHEN age >= 80 THEN '80+' WHEN age >= 60 THEN '60-79' WHEN age >= 40 THEN '40-59'
       WHEN age >= 18 THEN '18-39' END AS age_cat,
  com_a, com_b, com_c, com_n, com_n_cat, age_dx_1, code_1, morph_1, dx_date_1, code_2, morph_2, dx_date_2,
  n_records, loc_tumor, stage, tumour_type, ecog_num, has_second, metastasis,
  CASE WHEN (has_second = 'Si' OR metastasis = 'Si' OR COALESCE(stage IN ('distant', 'regional'), false)
             OR ecog_num > 1) THEN 'Grave'
       WHEN NOT (has_second = 'Si' OR metastasis = 'Si' OR COALESCE(stage IN ('distant', 'regional'), false)
             OR ecog_num > 1) THEN 'Leve' END AS severity,
  chemo, radio, treat_class, rtx_date, age_first, date_first, date_last, n_sessions, lag, event_study, event_date, died_study,
  died_cause_study, CASE WHEN event_study = 1 THEN CAST(event_date - date_last AS BIGINT) END AS days_chemo_event,
  CASE WHEN died_study = 1 THEN death_date END AS death_date_study,
  CASE WHEN dx_date_1 < DATE '{_S0}' THEN DATE '{_S0}' WHEN dx_date_1 >= DATE '{_S0}' THEN dx_date_1 END AS entry_date,
  CASE WHEN event_study = 0 AND died_study = 0 THEN DATE '{_S1}' WHEN event_study = 0 AND died_study = 1 THEN death_date
       WHEN event_study = 1 THEN event_date END AS exit_date
FROM k"""


@register("pipeline_registry_v2", sql=REGISTRY_V2_SQL)
def q_pipeline_registry_v2(spark, d):
    return P.clean_registry_v2(spark, d)


@register("logrank_many_groupings", sql="WITH " + REGISTRY_CTES + f""",
surv AS (SELECT * FROM ({_UNPIV}) u WHERE level IS NOT NULL AND time IS NOT NULL AND event IS NOT NULL),
c AS (SELECT variable, level AS g, time AS t, CAST(SUM(event) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS m
      FROM surv GROUP BY variable, level, time),
lv AS (SELECT DISTINCT variable, g FROM c), tt AS (SELECT DISTINCT variable, t FROM c),
grid AS (SELECT lv.variable, lv.g, tt.t, COALESCE(c.d, 0) AS d, COALESCE(c.m, 0) AS m
         FROM lv JOIN tt ON lv.variable = tt.variable
         LEFT JOIN c ON c.variable = lv.variable AND c.g = lv.g AND c.t = tt.t),
r AS (SELECT *, SUM(m) OVER (PARTITION BY variable, g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS r FROM grid),
x AS (SELECT *, SUM(r) OVER (PARTITION BY variable, t) AS n, SUM(d) OVER (PARTITION BY variable, t) AS dd FROM r),
s AS (SELECT variable, g, SUM(m) AS n_sub, SUM(d) AS o, SUM(dd * r / n) AS e,
             SUM(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) ELSE 0 END * (r / n) * (1 - r / n)) AS v
      FROM x GROUP BY variable, g)
SELECT variable, g AS level, CAST(n_sub AS BIGINT) AS n, ROUND(o, 6) AS observed, ROUND(e, 6) AS expected,
       ROUND(CASE WHEN e > 0 THEN (o - e) * (o - e) / e END, 6) AS oe2_e,
       ROUND(CASE WHEN v > 0 THEN (o - e) * (o - e) / v END, 6) AS oe2_v FROM s""")
def q_logrank_many(spark, d):
    from kohort.operators import survival as S
    t = S.logrank_many(P.clean_registry(spark, d), "time", "event", P.REPORT_GROUPINGS)
    return rounded(t.drop("chisq", "df", "p_value"))


@register("report_risk_table", sql="WITH " + REGISTRY_CTES + f""",
surv AS (SELECT * FROM ({_UNPIV}) u WHERE level IS NOT NULL AND time IS NOT NULL AND event IS NOT NULL),
b(bt) AS (VALUES {", ".join(f"({t})" for t in P.RISK_BREAKS)})
SELECT variable, level, CAST(bt AS BIGINT) AS time, CAST(SUM(CASE WHEN surv.time >= bt THEN 1 ELSE 0 END) AS BIGINT) AS n_risk
FROM surv, b GROUP BY variable, level, bt""")
def q_report_risk_table(spark, d):
    from kohort.operators import survival as S
    long = P.grouped(P.clean_registry(spark, d), "time", "event", P.REPORT_GROUPINGS)
    return S.risk_table(long, "time", "event", P.RISK_BREAKS, by=["variable", "level"])


@register("report_crosstab", sql="WITH " + REGISTRY_CTES + f""",
c AS (SELECT variable, level, event, CAST(COUNT(*) AS BIGINT) AS n FROM ({_UNPIV}) u
      WHERE level IS NOT NULL AND event IS NOT NULL GROUP BY variable, level, event)
SELECT variable, level, event, n, ROUND(n * 100.0 / SUM(n) OVER (PARTITION BY variable, level), 6) AS pct FROM c""")
def q_report_crosstab(spark, d):
    from kohort.operators import summary as SM
    return rounded(SM.crosstab(P.clean_registry(spark, d), P.REPORT_GROUPINGS, "event", "row"))
