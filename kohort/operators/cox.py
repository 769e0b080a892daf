"""Cox proportional hazards model with Efron ties, and its by-products
(survey 2.11, K10-K18).

Plan
----
* Design: categorical covariates become treatment-coded 0/1 columns
  against their first level (the level table's order); numeric ones are
  used as is.
* Sufficient table: ``groupBy(t, covariates)`` with deaths and counts, the
  only pass over the input.  For categorical covariates this is at most
  (patterns x distinct times) rows whatever the number of subjects.  It is
  checkpointed once to the shared ``spark.checkpoint.dir`` (reliable,
  lineage cut); level discovery and coding read the small table.
* One Newton iteration (:mod:`kohort.operators.cox_steps`): packed moments
  over a table that was range-partitioned by time once; no shuffle in a
  step.  Only the p-vector U and p x p matrices reach the driver, where the
  step is solved.  The plan is the same for any number of covariates and
  covariate patterns.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.functions.stats import Z975, chi2_sf, norm_sf2
from kohort.operators.cox_steps import laid_out, newton_parts
from kohort.operators.prefix import running_aggs, scaled_buckets
from kohort.session import materialize

STEPS_PER_ROW = 10_000  # Efron steps that one row stands for before the last explode


@dataclass
class Term:
    variable: str
    level: str | None      # None for a numeric covariate
    column: str            # design column name


@dataclass
class Design:
    terms: list[Term]
    ref_levels: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    @property
    def cols(self) -> list[str]:
        return [t.column for t in self.terms]


def group_levels(df: DataFrame, by: str, max_levels: int) -> list:
    """Sorted distinct non-NULL levels of a covariate; raises beyond ``max_levels``."""
    got = [r[0] for r in df.select(by).filter(F.col(by).isNotNull()).distinct().limit(max_levels + 1).collect()]
    if len(got) > max_levels:
        raise ValueError(f"{by}: more than {max_levels} levels")
    return sorted(got)


def build_design(df: DataFrame, covariates: list[str], levels: dict | None = None, max_levels: int = 200) -> Design:
    """Treatment coding.  ``levels`` may give a variable's level order
    (first = reference); otherwise levels are sorted.  Every level is a
    coefficient, and their p x p matrix is solved on the driver: a
    covariate of more than ``max_levels`` levels is refused."""
    levels = dict(levels or {})
    terms, refs = [], {}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for v in covariates:
        if types[v] in ("string", "boolean"):
            text = df.select(F.col(v).cast("string").alias(v))
            if v in levels:  # a value that isn't listed would pass for the reference level
                odd = text.filter(F.col(v).isNotNull() & ~F.col(v).isin(list(levels[v]))).first()
                if odd is not None:
                    raise ValueError(f"{v} has the value {odd[0]!r}, which is not among its levels")
            lv = levels.get(v) or [str(x) for x in group_levels(text, v, max_levels)]
            levels[v] = lv
            refs[v] = lv[0]
            for i, L in enumerate(lv[1:]):
                terms.append(Term(v, L, f"__x_{v}_{i + 1}"))
        else:
            terms.append(Term(v, None, f"__x_{v}"))
    return Design(terms, refs, levels)


def design_columns(df: DataFrame, design: Design) -> list:
    out = []
    for t in design.terms:
        if t.level is None:
            out.append(F.col(t.variable).cast("double").alias(t.column))
        else:
            out.append(F.when(F.col(t.variable).cast("string") == t.level, 1.0).otherwise(0.0).alias(t.column))
    return out


def complete_cases(df: DataFrame, time: str, event: str, covariates: list[str]) -> DataFrame:
    out = df
    for c in [time, event, *covariates]:
        out = out.filter(F.col(c).isNotNull())
    return out


def _eta(cols: list[str], beta) -> F.Column:
    e = F.lit(0.0)
    for c, b in zip(cols, beta):
        e = e + F.col(c) * F.lit(float(b))
    return e


def per_time_sums(suf: DataFrame, cols: list[str], beta) -> DataFrame:
    """Per distinct time: risk-set sums S0, S1_j, S2_jk (subjects with
    T >= t) and the deaths' sums D0, D1_j, D2_jk, XD_j, DE, dt
    (expressions as SQL text)."""
    p = len(cols)
    eta = " + ".join(f"({float(b)!r}D * `{c}`)" for c, b in zip(cols, beta)) or "0D"
    base = suf.selectExpr("*", f"({eta}) AS __eta", f"exp({eta}) AS __w")
    aggs = ["SUM(m * __w) AS a0", "SUM(d * __w) AS D0", "SUM(d) AS dt", "SUM(d * __eta) AS DE"]
    for j in range(p):
        aggs += [f"SUM(m * __w * `{cols[j]}`) AS a1_{j}", f"SUM(d * __w * `{cols[j]}`) AS D1_{j}",
                 f"SUM(d * `{cols[j]}`) AS XD_{j}"]
        for k in range(j, p):
            aggs += [f"SUM(m * __w * `{cols[j]}` * `{cols[k]}`) AS a2_{j}_{k}",
                     f"SUM(d * __w * `{cols[j]}` * `{cols[k]}`) AS D2_{j}_{k}"]
    pt = materialize(base.groupBy("t").agg(*[F.expr(a) for a in aggs]))   # a row a time
    suffix = {"S0": "a0"}
    for j in range(p):
        suffix[f"S1_{j}"] = f"a1_{j}"
        for k in range(j, p):
            suffix[f"S2_{j}_{k}"] = f"a2_{j}_{k}"
    return running_aggs(pt, [], "t", suffix_sums=suffix)


def efron_rows(pt: DataFrame, p: int) -> DataFrame:
    """Explode each event time into its Efron steps k = 0..d-1 with the
    reduced risk-set sums q0, q1_j, q2_jk (names unlike S0.. in more
    than case).  The tied deaths of one time are dealt out in runs of
    ``STEPS_PER_ROW`` steps, so that no task holds them all."""
    ev = pt.filter(F.col("dt") > 0).selectExpr(
        "*", f"explode(sequence(0L, CAST(dt AS BIGINT) - 1L, {STEPS_PER_ROW}L)) AS __k0").repartition("t", "__k0")
    ev = ev.selectExpr(
        "*", f"explode(sequence(__k0, least(__k0 + {STEPS_PER_ROW - 1}L, CAST(dt AS BIGINT) - 1L))) AS k").drop("__k0")
    exprs = ["(S0 - (k / dt) * D0) AS q0"]
    for j in range(p):
        exprs.append(f"(S1_{j} - (k / dt) * D1_{j}) AS q1_{j}")
        for k in range(j, p):
            exprs.append(f"(S2_{j}_{k} - (k / dt) * D2_{j}_{k}) AS q2_{j}_{k}")
    return ev.selectExpr("*", *exprs)


@dataclass
class CoxFit:
    design: Design
    beta: np.ndarray
    var: np.ndarray
    loglik0: float
    loglik: float
    score: float
    n: int
    n_events: int
    iterations: int
    suf: DataFrame
    raw: DataFrame | None = None  # checkpointed (t, raw covariates, d, m) the fit was built from
    covariates: tuple = ()
    converged: bool = True

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.var))

    def coef_rows(self) -> list[dict]:
        out = []
        for t, b, s in zip(self.design.terms, self.beta, self.se):
            z = b / s if s > 0 else float("nan")
            out.append({"variable": t.variable, "term": t.column.replace("__x_", ""),
                        "level": t.level, "coef": float(b), "exp_coef": math.exp(b), "se": float(s),
                        "z": float(z), "p_value": norm_sf2(z),
                        "lower": math.exp(b - Z975 * s), "upper": math.exp(b + Z975 * s)})
        return out

    def tests(self) -> dict:
        lr = 2.0 * (self.loglik - self.loglik0)
        try:
            wald = float(self.beta @ np.linalg.solve(self.var, self.beta)) if self.p else 0.0
        except np.linalg.LinAlgError:
            wald = float("nan")
        return {"n": self.n, "n_events": self.n_events, "loglik_null": self.loglik0, "loglik": self.loglik,
                "lr": lr, "lr_df": self.p, "lr_p": chi2_sf(lr, self.p),
                "wald": wald, "wald_p": chi2_sf(wald, self.p),
                "score": self.score, "score_p": chi2_sf(self.score, self.p),
                "iterations": self.iterations}


def _eliminated(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """A^-1 B by elimination with row exchanges, in row operations only: the driver shares its cores with Spark,
    and a linear algebra library's own threads can stall beside it."""
    M = np.concatenate([A, B.reshape(len(A), -1)], axis=1).astype(float)
    p = len(A)
    for k in range(p):
        best = k + int(np.abs(M[k:, k]).argmax())
        if M[best, k] == 0 or not np.isfinite(M[best, k]):
            raise np.linalg.LinAlgError("singular matrix")
        M[[k, best]] = M[[best, k]]
        M[k] /= M[k, k]
        others = M[:, k].copy()
        others[k] = 0.0
        M -= others[:, None] * M[k]
    return M[:, p:].reshape(B.shape)


def _solve(I: np.ndarray, U: np.ndarray) -> np.ndarray:
    """Newton step; a singular information matrix (no events, or a
    covariate without variation among the at-risk) falls back to the
    pseudo-inverse, which leaves the non-identified directions at 0."""
    try:
        return _eliminated(I, U)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(np.nan_to_num(I)) @ U


def _inverse(I: np.ndarray) -> np.ndarray:
    try:
        return _eliminated(I, np.eye(len(I)))
    except np.linalg.LinAlgError:
        return np.full_like(I, np.nan)


def raw_sufficient_table(df: DataFrame, time: str, event: str, covariates: list[str]) -> DataFrame:
    """``(t, raw covariates..., d, m)`` over complete cases: the single pass
    over the input a fit needs (map-side combined)."""
    cc = complete_cases(df, time, event, covariates)
    return cc.groupBy(F.col(time).alias("t"), *[F.col(c) for c in covariates]).agg(
        F.sum(F.col(event).cast("double")).alias("d"), F.count(F.lit(1)).cast("double").alias("m"))


def coxph(df: DataFrame, time: str, event: str, covariates: list[str], levels: dict | None = None,
          max_iter: int = 20, eps: float = 1e-9) -> CoxFit:
    """Fit by Newton-Raphson from beta = 0 with step halving; converged
    when the relative change of the log partial likelihood is below
    ``eps``.

    The input is read once: it is collapsed to (time, raw covariate
    values) and checkpointed to the shared ``spark.checkpoint.dir``
    (reliable: a lost executor does not send the fit back to the scan).
    Levels, treatment coding and every iteration work on that table.
    """
    raw = materialize(raw_sufficient_table(df, time, event, covariates))
    return _fit_raw(raw, list(covariates), levels, max_iter, eps)


def _fit_raw(raw: DataFrame, covariates: list[str], levels: dict | None, max_iter: int,
             eps: float) -> CoxFit:
    """Newton-Raphson on a (t, raw covariates, d, m) table."""
    design = build_design(raw, covariates, levels)
    coded = raw.select("t", *design_columns(raw, design), "d", "m")
    suf = coded.groupBy("t", *design.cols).agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    suf = materialize(suf)
    cols = design.cols
    p = len(cols)
    tot = suf.agg(F.sum("m").alias("n"), F.sum("d").alias("e"), F.count(F.lit(1)).alias("rows")).collect()[0]
    steps = laid_out(suf, cols, tot["rows"])
    beta, done = np.zeros(p), p == 0
    ll0, U, I = newton_parts(*steps, beta)
    score = float(U @ _solve(I, U)) if p else 0.0
    ll = ll0
    it = 0
    for it in range(1, max_iter + 1):
        step = _solve(I, U)
        new = beta + step
        ll_new, U_new, I_new = newton_parts(*steps, new)
        halvings = 0
        while ll_new < ll - 1e-12 and halvings < 10:
            new = (beta + new) / 2.0
            ll_new, U_new, I_new = newton_parts(*steps, new)
            halvings += 1
        done = abs(1.0 - ll_new / ll) <= eps if ll != 0 else abs(ll_new - ll) <= eps
        beta, ll, U, I = new, ll_new, U_new, I_new
        if done:
            break
    if not done:
        warnings.warn(f"the Cox fit did not converge in {max_iter} steps", stacklevel=3)
    return CoxFit(design, beta, _inverse(I), ll0, ll, score, int(tot["n"] or 0), int(tot["e"] or 0), it, suf,
                  raw, tuple(covariates), bool(done))


def coef_table(spark: SparkSession, fit: CoxFit) -> DataFrame:
    return spark.createDataFrame(fit.coef_rows(), "variable string, term string, level string, coef double, "
                                 "exp_coef double, se double, z double, p_value double, lower double, upper double")


def summary_table(spark: SparkSession, fit: CoxFit) -> DataFrame:
    return spark.createDataFrame([fit.tests()], "n bigint, n_events bigint, loglik_null double, loglik double, "
                                 "lr double, lr_df bigint, lr_p double, wald double, wald_p double, score double, "
                                 "score_p double, iterations bigint")


def hazard_ratio_table(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """Variable, level, HR, 95% limits, p, with a row for each reference
    level (HR NULL)."""
    rows = []
    seen = set()
    for r in fit.coef_rows():
        v = r["variable"]
        if r["level"] is not None and v not in seen:
            seen.add(v)
            rows.append({"variable": v, "level": fit.design.ref_levels[v], "hr": None, "lower": None,
                         "upper": None, "p_value": None, "reference": True})
        rows.append({"variable": v, "level": r["level"], "hr": r["exp_coef"], "lower": r["lower"],
                     "upper": r["upper"], "p_value": r["p_value"], "reference": False})
    return spark.createDataFrame(rows, "variable string, level string, hr double, lower double, upper double, "
                                 "p_value double, reference boolean")


def nested_test(spark: SparkSession, full: CoxFit, reduced: CoxFit) -> DataFrame:
    """Likelihood-ratio test between nested models fitted on the same rows."""
    lr = 2.0 * (full.loglik - reduced.loglik)
    df_ = full.p - reduced.p
    return spark.createDataFrame([{"loglik_reduced": reduced.loglik, "loglik_full": full.loglik,
                                   "chisq": lr, "df": df_, "p_value": chi2_sf(lr, df_)}],
                                 "loglik_reduced double, loglik_full double, chisq double, df bigint, p_value double")


def drop_term(df: DataFrame, time: str, event: str, fit: CoxFit, covariates: list[str], term: str) -> CoxFit:
    """Refit without one covariate on the same rows.

    The reduced model's sufficient table is the fitted model's table summed
    over the dropped covariate, so the input is not read again."""
    keep = [c for c in covariates if c != term]
    if fit.raw is not None and list(fit.covariates) == list(covariates):
        raw = fit.raw.groupBy("t", *keep).agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
        return _fit_raw(raw, keep, fit.design.levels, 20, 1e-9)
    cc = complete_cases(df, time, event, covariates)
    return coxph(cc, time, event, keep, levels=fit.design.levels)


# --- baseline hazard and residuals -------------------------------------------

def baseline_table(fit: CoxFit) -> DataFrame:
    """Per distinct time: Efron baseline hazard increment ``haz`` (for
    subjects at risk), the tied deaths' own share ``hd``, cumulative
    hazard ``cumhaz`` and the Efron-averaged covariate means ``xbar_j``.
    (Names differ by more than case: Spark resolves columns
    case-insensitively.)  One row per distinct time, checkpointed: the
    residuals and curves read it several times."""
    cols = fit.design.cols
    p = len(cols)
    pt = per_time_sums(fit.suf, cols, fit.beta)
    ex = efron_rows(pt, p)
    inc = ex.groupBy("t").agg(
        F.sum(1.0 / F.col("q0")).alias("haz"),
        F.sum((1.0 - F.col("k") / F.col("dt")) / F.col("q0")).alias("hd"),
        *[F.avg(F.col(f"q1_{j}") / F.col("q0")).alias(f"xbar_{j}") for j in range(p)])
    allt = materialize(pt.select("t").join(inc, "t", "left").fillna(0.0, subset=["haz", "hd"]))
    return materialize(_cum_hazard(allt))


def _cum_hazard(allt: DataFrame) -> DataFrame:
    b = scaled_buckets(allt, [], "t")
    return running_aggs(b, [], "t", sums={"cumhaz": "haz"}, bucket_col="__qb")


def martingale_by_pattern(fit: CoxFit) -> DataFrame:
    """Martingale residual for each (t, pattern, event) cell:
    event - exp(eta) * (cumhaz before t + own increment at t), where a death's
    own increment is its Efron share."""
    cols = fit.design.cols
    base = baseline_table(fit).select("t", "haz", "hd", "cumhaz")
    suf = fit.suf.join(base, "t", "left")
    w = F.exp(_eta(cols, fit.beta))
    before = F.col("cumhaz") - F.col("haz")
    # a (t, pattern) cell holds d deaths and m - d survivors
    dead = F.col("d") * (1.0 - w * (before + F.col("hd")))
    alive = (F.col("m") - F.col("d")) * (0.0 - w * (before + F.col("haz")))
    return suf.withColumns({
        "res_dead": 1.0 - w * (before + F.col("hd")),
        "res_alive": 0.0 - w * (before + F.col("haz")),
        "res_sum": dead + alive,
        "res_sq": F.col("d") * F.pow(1.0 - w * (before + F.col("hd")), 2)
                  + (F.col("m") - F.col("d")) * F.pow(w * (before + F.col("haz")), 2),
    })


def martingale_residuals(fit: CoxFit, df: DataFrame, time: str, event: str, covariates: list[str],
                         id_col: str) -> DataFrame:
    """Per subject: ``id, time, event, residual`` (equi join of the
    subjects to their (time, pattern) cell)."""
    cc = complete_cases(df, time, event, covariates)
    cols = fit.design.cols
    subj = cc.select(id_col, F.col(time).alias("t"), F.col(event).cast("double").alias("e"),
                     *design_columns(cc, fit.design))
    cells = martingale_by_pattern(fit).select("t", *cols, "res_dead", "res_alive")
    j = subj.join(cells, ["t", *cols], "left")
    return j.select(id_col, F.col("t").alias(time), F.col("e").cast("bigint").alias(event),
                    F.when(F.col("e") > 0, F.col("res_dead")).otherwise(F.col("res_alive")).alias("residual"))


def schoenfeld_residuals(fit: CoxFit, df: DataFrame, time: str, event: str, covariates: list[str],
                         id_col: str) -> DataFrame:
    """Per death and term: x - Efron-averaged weighted risk-set mean."""
    cc = complete_cases(df, time, event, covariates).filter(F.col(event) > 0)
    cols = fit.design.cols
    subj = cc.select(id_col, F.col(time).alias("t"), *design_columns(cc, fit.design))
    base = baseline_table(fit).select("t", *[f"xbar_{j}" for j in range(len(cols))])
    j = subj.join(base, "t", "left")
    terms = [t.column.replace("__x_", "") for t in fit.design.terms]
    stack = ", ".join(f"'{terms[i]}', {cols[i]} - xbar_{i}" for i in range(len(cols)))
    return j.selectExpr(id_col, f"t AS {time}", f"stack({len(cols)}, {stack}) AS (term, residual)")


def fit_metrics(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """AIC, BIC (events as sample size), Nagelkerke R2, RMSE of martingale
    residuals."""
    ss = martingale_by_pattern(fit).agg(F.sum("res_sq").alias("ss")).collect()[0]["ss"]
    n, k = fit.n, fit.p
    nan = float("nan")
    aic = -2 * fit.loglik + 2 * k
    bic = -2 * fit.loglik + k * math.log(fit.n_events) if fit.n_events > 0 else nan
    r2cs = 1 - math.exp(2 * (fit.loglik0 - fit.loglik) / n) if n else nan
    r2max = 1 - math.exp(2 * fit.loglik0 / n) if n else nan
    r2 = r2cs / r2max if r2max and not math.isnan(r2max) else nan
    return spark.createDataFrame([{"aic": aic, "bic": bic, "r2_nagelkerke": r2,
                                   "rmse": math.sqrt((ss or 0.0) / n) if n else nan}],
                                 "aic double, bic double, r2_nagelkerke double, rmse double")


PATTERNS_PER_BLOCK = 1024


def adjusted_curves(fit: CoxFit, variable: str) -> DataFrame:
    """Predicted survival per level of ``variable`` at each event time,
    averaged over the sample's mix of the other covariates:
    S_L(t) = sum_p m_p exp(-cumhaz(t) exp(eta_p(L))) / sum_p m_p.

    The other covariates' patterns are summed to (risk, m) and dealt into
    blocks; every (level, time) meets every block by its number and sums
    over the block in place, so that any number of patterns will do."""
    d = fit.design
    if variable not in d.levels:
        raise ValueError(f"{variable} is no categorical covariate of the fit")
    own = {t.level: float(b) for t, b in zip(d.terms, fit.beta) if t.variable == variable}
    others = [(t.column, b) for t, b in zip(d.terms, fit.beta) if t.variable != variable]
    risk = F.exp(_eta([c for c, _ in others], [b for _, b in others]))
    pats = materialize(fit.suf.groupBy(risk.alias("risk")).agg(F.sum("m").alias("m")))
    size = pats.agg(F.count("*").alias("n"), F.sum("m").alias("m")).first()
    n_blocks = max(1, -(-size["n"] // PATTERNS_PER_BLOCK))
    blocks = pats.groupBy(F.pmod(F.xxhash64("risk"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("risk", "m")).alias("patterns"))   # about PATTERNS_PER_BLOCK
    levels = F.array(*[F.struct(F.lit(L).alias("level"), F.lit(math.exp(own.get(L, 0.0))).alias("own"))
                       for L in d.levels[variable]])
    at = (baseline_table(fit).filter(F.col("haz") > 0).select("t", "cumhaz", F.explode(levels).alias("l"))
          .select("t", "cumhaz", "l.*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")).alias("block")))
    part = F.aggregate("patterns", F.lit(0.0), lambda s, p: s + p["m"] * F.exp(-F.col("cumhaz") * F.col("own") * p["risk"]))
    return (at.join(blocks, "block").groupBy("level", "t").agg(F.sum(part).alias("s"))
            .select(F.col("level").alias(variable), F.col("t").alias("time"), (F.col("s") / float(size["m"] or 1)).alias("surv")))


def concordance(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """Harrell's C and its standard error from (time, risk score, event) counts.

    A pair is comparable when the earlier time is a death and the other
    subject is still at risk after it (or censored at the same time);
    concordant when the earlier death has the higher risk score; equal
    scores count one half.

    No pairs are formed and any number of scores will do.  Scores are
    ranked; of two different ranks the higher one has the 1 at the highest
    bit in which they differ.  So each cell stands once for every bit, in
    the group of the cells that agree above that bit, and running sums over
    time within such groups count, for each subject, the partners of higher
    and of lower score.  The standard error is the infinitesimal jackknife
    over those counts per subject."""
    eta = F.round(_eta(fit.design.cols, fit.beta), 12)
    cells = materialize(fit.suf.groupBy("t", eta.alias("eta")).agg(F.sum("d").alias("d"), F.sum("m").alias("m")))
    scores = materialize(cells.select("eta").distinct().withColumn("one", F.lit(1)))
    bits = max(1, scores.count().bit_length())
    ranks = running_aggs(scores, [], "eta", sums={"r": "one"})
    cells = materialize(cells.join(ranks.select("eta", F.col("r").cast("bigint").alias("r")), "eta")
                        .select("t", "d", "m", "r", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("bit"))
                        # bit -1: the cells of equal score
                        .selectExpr("*", "shiftright(r, bit + 1) AS above",
                                    "CASE WHEN bit < 0 THEN 0 ELSE shiftright(r, bit) & 1 END AS side"))
    sides = cells.groupBy("bit", "above", "t").agg(*[
        F.sum(F.when(F.col("side") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for c in "dm" for k in (0, 1)])
    run = running_aggs(materialize(sides), ["bit", "above"], "t", suffix_sums={"R0": "m0", "R1": "m1"},
                       sums={"P0": "d0", "P1": "d1"})
    each = cells.join(run, ["bit", "above", "t"])

    # partners of one subject that died (first) or was censored (second) in the cell
    counts = {
        "conc": ("IF(side = 1, R0 - d0, P1 - d1)", "IF(side = 1, 0D, P1)", "bit >= 0"),
        "disc": ("IF(side = 0, R1 - d1, P0 - d0)", "IF(side = 0, 0D, P0)", "bit >= 0"),
        "tied": ("(R0 - d0) + (P0 - d0)", "P0", "bit < 0"),
    }
    subject = each.groupBy("t", "r").agg(F.first("d").alias("d"), F.first("m").alias("m"), *[
        F.expr(f"SUM(IF({when}, {e}, 0D)) AS {name}_{kind}")
        for name, (dead, alive, when) in counts.items() for kind, e in (("d", dead), ("c", alive))])
    kinds = (("d", "d"), ("(m - d)", "c"))
    total = {n: " + ".join(f"{w} * {n}_{k}" for w, k in kinds) for n in counts}
    x, n = "(conc_{0} - disc_{0})", "(conc_{0} + disc_{0} + tied_{0})"

    def squares(a, b):
        return "SUM(" + " + ".join(f"{w} * {a.format(k)} * {b.format(k)}" for w, k in kinds) + ")"
    sums = subject.selectExpr(
        # each pair is counted at both of its ends
        f"SUM({total['conc']}) / 2 AS concordant", f"SUM({total['disc']}) / 2 AS discordant",
        f"SUM({total['tied']}) / 2 AS tied_risk", f"{squares(x, x)} AS xx", f"{squares(x, n)} AS xn", f"{squares(n, n)} AS nn")
    sums = sums.selectExpr("*", "concordant + discordant + tied_risk AS pairs")
    sums = sums.selectExpr("*", "IF(pairs > 0, (concordant - discordant) / pairs, NULL) AS gap")
    return sums.selectExpr("concordant", "discordant", "tied_risk",
                           "IF(pairs > 0, (concordant + 0.5D * tied_risk) / pairs, NULL) AS concordance",
                           "IF(pairs > 0, sqrt(greatest(xx - 2 * gap * xn + gap * gap * nn, 0D)) / (2 * pairs), NULL) AS std_err")
