"""End-to-end jobs (survey 2.12, P1-P3) composed from the operators.

``clean_registry`` is the cleaning pipeline on the registry-shaped
fixtures: one row per subject with derived cohort variables.
``cohort_report`` runs the analysis on it and returns named DataFrames.
Subjects are customers; records, sessions, indicator rows and tests are
the fixtures keyed to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions import dates as D
from kohort.functions import recode as R
from kohort.functions import rowwise as RW
from kohort.functions.nulls import isin_or_false
from kohort.operators import aggregate as agg
from kohort.operators import assoc as A
from kohort.operators import levels as LV
from kohort.operators import columns as C
from kohort.operators import cox as CX
from kohort.operators import dedup
from kohort.operators import filters as flt
from kohort.operators import joins as J
from kohort.operators import lookup as LK
from kohort.operators import summary as SM
from kohort.operators import survival as S
from kohort.plans import fixtures as fx
from kohort.plans.q_filters import EXCLUDED_SUBJECTS
from kohort.session import materialize
from kohort.sources.io import NA_TOKENS_V1, nullify_tokens, table

# Study parameters of the registry pipeline.
SESSION_PERIOD = ("1995-01-01", "1996-12-31")
REF_YEAR = 1996
TEST_YEAR = 2024
TEST_ORIGIN, TEST_END = "2024-01-01", "2024-01-31"
CODE_GROUPS = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low")]
COMORB_BANDS = ("none", "one", "two or more")


DX_LIMIT = "1997-06-01"
RTX_LIMIT = "1996-12-31"
RTX_PATCHES = [(11, "rtx_date", "1995-09-10", False), (22, "rtx_date", "1995-09-19", False),
               (31, "rtx_date", "1995-10-14", False)]
STAGE_FILL_SUBJECT = 7
BLOOD_CODE = "3-MEDIUM"
BOTH_TYPES_SUBJECTS = [13, 29]
SOLID, BLOOD, BOTH = "Sólido", "Hematológico", "Ambos"
TREATMENTS = ("Quimioterapia y radioterapia", "Quimioterapia", "Radioterapia", "Ninguno")
IDENTIFIERS = ["record_id", "doc_number"]


def subject_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Treatment sessions with the subject they belong to (by the order key)."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sess = fx.fx_sess(spark, d)
    return sess.join(orders, sess.subject_id == orders.o_orderkey, "inner") \
        .select(F.col("o_custkey").alias("subject_id"), "age", "session_date", "rtx_date")


def treatments(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    """One row per subject: chemotherapy and radiotherapy flags, session
    summary, first radiotherapy date with its corrections, treatment class.

    ``strict``: second pipeline's rules (radiotherapy dates beyond the limit
    are filtered before the join, and a missing session age is kept)."""
    base = C.mutate_across(nullify_tokens(fx.fx_treat(spark, d), NA_TOKENS_V1), ["chemo", "radio"], R.title_case)
    base = dedup.first_per_key(base, ["subject_id"], ["record_id"]).drop("record_id")
    sess = subject_sessions(spark, d)
    summary = agg.session_summary_strict if strict else agg.session_summary
    summ = summary(sess, "subject_id", "session_date", "age", *SESSION_PERIOD)
    rtx = flt.require_not_null(sess.select("subject_id", "rtx_date"), "rtx_date")
    if strict:
        rtx = flt.in_period(rtx, "rtx_date", hi=RTX_LIMIT)
    rtx = dedup.first_per_key(rtx, ["subject_id"], ["rtx_date"])
    t = J.natural_join(J.natural_join(base, summ, "left"), rtx, "left")
    t = LK.apply_patches(t, "subject_id", LK.patch_table(spark, RTX_PATCHES), columns=["rtx_date"],
                         null_rules={"rtx_date": F.col("rtx_date") > F.lit(RTX_LIMIT).cast("date")})
    return t.withColumn("treat_class", R.two_flag_class("chemo", "radio", labels=TREATMENTS, default=TREATMENTS[-1]))


def clean_registry(spark: SparkSession, d: str) -> DataFrame:
    # raw extract: missing tokens, headers, benign records, sex
    raw = C.clean_names(nullify_tokens(fx.fx_raw(spark, d), NA_TOKENS_V1))
    raw = C.rename(raw, {"subject_id": "id_pte", "record_id": "num_registro", "doc_number": "num_doc",
                         "sex": "ptesxn_x", "behaviour": "compn"})
    raw = flt.exclude_value(raw, "behaviour", "Benigno").drop("behaviour").withColumns({
        "subject_id": R.to_number("subject_id", "bigint"), "record_id": R.to_number("record_id", "bigint"),
        "sex": R.recode2(F.col("sex") == "Mujer", "Femenino", "Masculino")})

    # registry records: exclusions, recodes, repeated records, corrections
    rec = flt.exclude_bad_records(
        fx.fx_rec(spark, d), "subject_id",
        LK.literal_table(spark, [(i,) for i in EXCLUDED_SUBJECTS], "subject_id bigint"))
    rec = J.natural_join(rec, raw, "inner")
    rec = rec.withColumns({
        "tumour_type": R.recode_regex("morph", "[Mm]etas", SOLID, BLOOD),
        "ecog_num": R.leading_grade("ecog_txt", ["Unknown"]),
        "morph_code": R.substr_inclusive(R.split_first("morph", "-")[0], 2, 5),
    })
    rec = dedup.first_per_key(rec, ["subject_id", "birth_date", "sex", "code", "stage", "ecog_txt", "morph"],
                              [("dx_date", "desc"), "record_id"])
    rec = LK.patch_where(rec, [
        ("stage", (F.col("subject_id") == STAGE_FILL_SUBJECT) & F.col("stage").isNull(), "local"),
        ("tumour_type", F.col("code") == BLOOD_CODE, BLOOD)])

    # one row per subject
    col = agg.collapse_multi(rec, ["subject_id"], ["code", "morph", "morph_code"], ["dx_date", "record_id"],
                             first_only=["stage", "tumour_type", "birth_date", "dx_date", "sex", "doc_number"],
                             strict_max_cols=["ecog_num"])
    col = LK.patch_where(col, [("tumour_type", F.col("subject_id").isin(BOTH_TYPES_SUBJECTS), BOTH)])

    # first and second diagnosis date, diagnosed before the limit
    dates = agg.spread_nth(fx.fx_rec(spark, d).select("subject_id", "birth_date", "dx_date", "record_id"),
                           ["subject_id", "birth_date"], "dx_date", ["dx_date", "record_id"], prefix="dx")
    dates = flt.in_period(dates, "dx_1", hi=DX_LIMIT, hi_open=True)

    # comorbidity indicators: any positive record per subject, count, band
    flags = agg.mean_indicators(fx.fx_flags(spark, d), ["subject_id"], fx.FLAG_COLS)
    flags = C.mutate_across(flags, fx.FLAG_COLS, lambda c: F.ceil(c))
    flags = flags.withColumns({"com_n": RW.row_sum(fx.FLAG_COLS), "com_missing": RW.row_null_count(fx.FLAG_COLS)}) \
        .withColumn("com_band", R.count_bands("com_n", COMORB_BANDS, "unknown"))
    flags = C.mutate_across(flags, fx.FLAG_COLS, lambda c: R.recode2(c == 1, "Si", "No"))

    # repeated tests -> one per subject (positive first, latest first)
    tests = dedup.first_per_key(fx.fx_tests(spark, d).select("subject_id", "event_id", "test_date", "result"),
                                ["subject_id"], [("result", "desc"), ("test_date", "desc"), "event_id"])
    tests = tests.select("subject_id", "test_date", "result")

    j = J.natural_join(col, dates, "inner")
    j = J.natural_join(j, treatments(spark, d), "inner")
    j = J.natural_join(j, flags, "left")
    j = J.natural_join(j, tests, "left")

    lookup = LK.literal_table(spark, CODE_GROUPS, "code string, label string")
    j = LK.code_to_group(j, "code_1", lookup, "code_group", "other")
    event = D.in_year_flag(F.col("result") == "purchase", "test_date", TEST_YEAR)
    metastasis = R.case_map([(F.col("stage") == "distant", "Si"),
                             (R.text_flag(["morph_1"], "metas", "inc"), "Si"),
                             (R.text_flag(["morph_2"], "metas", "inc"), "Si")], "No")
    j = j.withColumns({
        "age": D.age_by_year(REF_YEAR, "birth_date"),
        "age_dx": D.years_between("birth_date", "dx_1"),
        "has_second": F.when(F.col("code_2").isNotNull(), "Si").otherwise("No"),
        "metastasis": metastasis,
        "event": event.cast("bigint"),
    })
    j = dedup.first_per_key(j, ["subject_id"], [("event", "desc"), "code_2"])
    j = j.withColumns({
        "age_cat": R.age_bands("age"),
        "severity": R.severity([F.col("has_second") == "Si", F.col("metastasis") == "Si",
                                isin_or_false("stage", ["distant", "regional"]), F.col("ecog_num") > 1]),
        "days_dx_event": F.when(F.col("event") == 1, D.days_between("dx_1", "test_date")),
        "days_chemo_event": F.when(F.col("event") == 1, D.days_between("date_last", "test_date")),
        "time": D.time_to_event("event", "test_date", TEST_ORIGIN, TEST_END),
    })
    return C.final_projection(j, [
        "subject_id", "sex", "birth_date", "age", "age_cat", "age_dx", C.starts_with("co_f"), "com_n", "com_missing",
        "com_band", C.ends_with("_1"), C.ends_with("_2"), "n_records", "code_group", "stage", "tumour_type", "ecog_num",
        "has_second", "metastasis", "severity", "chemo", "radio", "treat_class", "rtx_date", "age_first", "date_first",
        "date_last", "n_sessions", "test_date", "result", "event", "days_dx_event", "days_chemo_event", "time"],
        identifiers=IDENTIFIERS)


REPORT_GROUPINGS = ["sex", "age_cat", "tumour_type", "code_group", "has_second", "metastasis", "severity", "com_band",
                    "treat_class"]
RISK_BREAKS = [0, 10, 20, 30]


def km_many(df: DataFrame, time: str, event: str, groupings: list[str]) -> DataFrame:
    """Curves for several groupings in one job: grouping columns are
    unpivoted to ``(variable, level)`` and the curve is stratified by both."""
    return S.kaplan_meier(grouped(df, time, event, groupings), time, event, by=["variable", "level"])


def grouped(df: DataFrame, time: str, event: str, groupings: list[str]) -> DataFrame:
    """``variable, level, time, event``: each row once for every grouping column."""
    return SM.unpivot(df, groupings, keep=[time, event], variable="variable", value="level")


def cohort_report(spark: SparkSession, d: str, reg: DataFrame | None = None,
                  cox_covariates: tuple[str, ...] = ("treat_class", "age_cat")) -> dict:
    """Descriptive tables, curves for every grouping, log-rank per grouping,
    and a Cox model with its by-products (the model fit runs when called).
    The cohort is written once (a checkpoint) and every table reads that."""
    reg = materialize(reg if reg is not None else clean_registry(spark, d))
    curves = materialize(km_many(reg, "time", "event", REPORT_GROUPINGS))
    by = ["variable", "level"]
    out = {
        "levels_tumour_type": LV.relevel(LV.levels_from(reg, "tumour_type"), first=["Sólido"]),
        "levels_code_group": LV.relevel(LV.levels_by_freq(reg, "code_group"), last=["other"]),
        "association": A.association_table(reg, ["age_cat", "tumour_type", "severity", "com_band"],
                                           ["age", "ecog_num"], "event"),
        "missing": SM.na_pareto(reg),
        "categorical": SM.summary_categorical(reg, ["age_cat", "tumour_type", "stage", "severity", "com_band"]),
        "continuous": SM.summary_continuous(reg, ["age", "ecog_num", "n_sessions"]),
        "continuous_by_event": SM.summary_continuous(reg, ["age", "ecog_num", "n_sessions"], by=["event"]),
        "crosstab_event": SM.crosstab(reg, REPORT_GROUPINGS, "event", "row"),
        "km_overall": S.kaplan_meier(reg, "time", "event"),
        "km_groupings": curves,
        "km_medians": S.km_summary(curves, by=by),
        "km_points": S.curve_points(curves, by=by, ylim=(0.75, 1.0)),
        "risk_table": S.risk_table(grouped(reg, "time", "event", REPORT_GROUPINGS), "time", "event", RISK_BREAKS, by=by),
    }
    out["logrank"] = S.logrank_many(reg, "time", "event", REPORT_GROUPINGS)
    if cox_covariates:
        covs = list(cox_covariates)
        fit = CX.coxph(reg, "time", "event", covs)
        out["cox_coefficients"] = CX.coef_table(spark, fit)
        out["cox_summary"] = CX.summary_table(spark, fit)
        out["cox_hazard_ratios"] = CX.hazard_ratio_table(spark, fit)
        out["cox_concordance"] = CX.concordance(spark, fit)
        out["cox_fit_metrics"] = CX.fit_metrics(spark, fit)
        for v in fit.design.levels:
            out[f"cox_adjusted_curves_{v}"] = CX.adjusted_curves(fit, v)
        out["cox_schoenfeld"] = CX.schoenfeld_residuals(fit, reg, "time", "event", covs, "subject_id")
        out["cox_martingale"] = CX.martingale_residuals(fit, reg, "time", "event", covs, "subject_id")
        if len(covs) > 1:
            reduced = CX.drop_term(reg, "time", "event", fit, covs, covs[-1])
            out["cox_nested_test"] = CX.nested_test(spark, fit, reduced)
    return out


# Parameters of the second cleaning pipeline.
V2_STUDY = ("1996-03-03", "1996-12-31")
V2_STUDY_YEAR = 1996
V2_LAG_MIN_DAYS = 10
V2_EXCLUDED_CODE = "5-LOW"
V2_FILL_SUBJECT = 7
V2_SITE_RULES = [("^1-", "urgent site"), ("^2-", "high site"), ("^3-", "medium site")]
V2_BANDS = ("Sin comorbilidades", "Una comorbilidad", "Dos comorbilidades", "Más de dos comorbilidades")


def clean_registry_v2(spark: SparkSession, d: str) -> DataFrame:
    """Second cleaning pipeline: record filters, per-record comorbidity
    groups joined to the registry, subject means of the groups (a mean can
    be fractional and then bands as unknown), strict session summary, lag
    filter, cohort entry/exit dates."""
    rec = flt.require_not_null(fx.fx_rec(spark, d), "dx_date")
    rec = flt.exclude_value(rec, "code", V2_EXCLUDED_CODE)
    rec = flt.exclude_bad_records(
        rec, "subject_id", LK.literal_table(spark, [(i,) for i in EXCLUDED_SUBJECTS], "subject_id bigint"))
    fl = fx.fx_flags(spark, d).select("record_id", "subject_id", *fx.FLAG_COLS)
    fl = fl.withColumns({"com_a": RW.row_any(["co_f1", "co_f2"]), "com_b": RW.row_any(["co_f3", "co_f4"]),
                         "com_c": RW.row_any(["co_f5", "co_f6"])})
    fl = fl.withColumn("com_n", RW.row_sum(["com_a", "com_b", "com_c"])) \
        .select("record_id", "subject_id", "com_a", "com_b", "com_c", "com_n")
    r = J.natural_join(rec, fl, "inner")
    r = r.withColumns({
        "tumour_type": F.when(R.rlike_or_false("morph", "metas inc") | R.rlike_or_false("code", "^1-"),
                              "Hematológico").otherwise("Sólido"),
        "ecog_num": R.leading_grade("ecog_txt", ["Unknown"]),
        "stage": R.case_map([((F.col("subject_id") == V2_FILL_SUBJECT) & F.col("stage").isNull(), "local"),
                             (F.col("stage").isNull(), "unknown")], F.col("stage")),
    })
    col = agg.collapse_multi(r, ["subject_id"], ["code", "morph", "dx_date"], ["dx_date", "record_id"],
                             first_only=["stage", "tumour_type", "birth_date"], strict_max_cols=["ecog_num"],
                             mean_cols=["com_a", "com_b", "com_c", "com_n"])

    ent = fx.fx_entry(spark, d).select("subject_id", "event_date", "death_date")

    j = J.natural_join(J.natural_join(col, treatments(spark, d, strict=True), "inner"), ent, "left")
    j = j.withColumn("lag", D.days_between("dx_date_1", "event_date"))
    j = flt.at_least_or_null(j, "lag", V2_LAG_MIN_DAYS)
    ev = D.in_year_flag(F.col("event_date").isNotNull(), "event_date", V2_STUDY_YEAR)
    died = D.in_year_flag(F.col("death_date").isNotNull(), "death_date", V2_STUDY_YEAR)
    cause = D.in_year_flag(F.col("event_date") <= F.col("death_date"), "death_date", V2_STUDY_YEAR)
    metastasis = R.case_map([(F.col("stage") == "distant", "Si"),
                             (R.text_flag(["morph_1"], "metas", "inc"), "Si"),
                             (R.text_flag(["morph_2"], "metas", "inc"), "Si")], "No")
    j = j.withColumns({
        "age": D.age_by_year(V2_STUDY_YEAR, "birth_date"),
        "age_dx_1": D.years_between("birth_date", "dx_date_1"),
        "has_second": F.when(F.col("code_2").isNotNull(), "Si").otherwise("No"),
        "metastasis": metastasis,
        "event_study": ev.cast("bigint"),
        "died_study": died.cast("bigint"),
        "died_cause_study": cause.cast("bigint"),
        "com_n_cat": R.count_bands("com_n", V2_BANDS, "Desconocido"),
        "loc_tumor": LK.code_to_group_regex("code_1", V2_SITE_RULES, "other"),
    })
    j = j.withColumns({
        "age_cat": R.age_bands("age"),
        "severity": R.severity([F.col("has_second") == "Si", F.col("metastasis") == "Si",
                                isin_or_false("stage", ["distant", "regional"]), F.col("ecog_num") > 1]),
        "days_chemo_event": F.when(F.col("event_study") == 1, D.days_between("date_last", "event_date")),
        "death_date_study": F.when(F.col("died_study") == 1, F.col("death_date")),
        "entry_date": D.clamp_entry("dx_date_1", V2_STUDY[0]),
        "exit_date": D.cohort_exit("event_study", "event_date", "died_study", "death_date", V2_STUDY[1]),
    })
    return C.final_projection(j, [
        "subject_id", "birth_date", "age", "age_cat", C.starts_with("com_"), "age_dx_1",
        C.ends_with("_1"), C.ends_with("_2"), "n_records", "loc_tumor", "stage", "tumour_type", "ecog_num",
        "has_second", "metastasis", "severity", "chemo", "radio", "treat_class", "rtx_date", "age_first", "date_first",
        "date_last", "n_sessions", "lag", "event_study", "event_date", "days_chemo_event", "died_study",
        "died_cause_study", "death_date_study", "entry_date", "exit_date"],
        identifiers=IDENTIFIERS)


V1_REPORT_COLUMNS = {"time", "event", "subject_id", "tumour_type", "code_group", *REPORT_GROUPINGS}
V2_REPORT_COLUMNS = {"subject_id", "entry_date", "exit_date", "event_study", "tumour_type", "loc_tumor",
                     "age_cat", "severity", "com_n_cat", "age", "ecog_num"}


def cohort_report_v2(spark: SparkSession, reg: DataFrame) -> dict:
    """Report for a cohort with entry/exit dates: summaries, association by
    the in-year event, and the delayed-entry curve on (entry, exit]."""
    start = V2_STUDY[0]
    surv = reg.select(D.days_between(start, "entry_date").alias("start"),
                      D.days_between(start, "exit_date").alias("stop"), "event_study")
    return {
        "levels_tumour_type": LV.relevel(LV.levels_from(reg, "tumour_type"), first=["Sólido"]),
        "levels_loc_tumor": LV.relevel(LV.levels_by_freq(reg, "loc_tumor"), last=["other"]),
        "missing": SM.na_pareto(reg),
        "categorical": SM.summary_categorical(reg, ["age_cat", "tumour_type", "loc_tumor", "severity",
                                                     "com_n_cat"]),
        "continuous": SM.summary_continuous(reg, ["age", "ecog_num", "n_sessions"]),
        "association": A.association_table(reg, ["age_cat", "tumour_type", "severity", "com_n_cat"],
                                           ["age", "ecog_num"], "event_study"),
        "km_delayed_entry": S.km_delayed_entry(surv, "start", "stop", "event_study"),
        "km_delayed_entry_excluded": S.delayed_entry_excluded(surv, "start", "stop"),
    }


def report_for(spark: SparkSession, reg: DataFrame) -> dict:
    """Pick the report by the cohort's schema, checked at the boundary."""
    cols = set(reg.columns)
    if V1_REPORT_COLUMNS <= cols:
        return cohort_report(spark, "", reg=reg)
    if V2_REPORT_COLUMNS <= cols:
        return cohort_report_v2(spark, reg)
    missing_v1 = sorted(V1_REPORT_COLUMNS - cols)
    missing_v2 = sorted(V2_REPORT_COLUMNS - cols)
    raise ValueError(f"cohort fits neither report schema; missing {missing_v1} (v1) or {missing_v2} (v2)")
