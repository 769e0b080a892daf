"""Registered queries: Cox model and its by-products.

The one-covariate model (exposure on FX-SURV) has a SQL oracle: ten
unrolled Newton steps on the per-time table.  The two-covariate model's
oracle unrolls its steps in long form, with a 5 x 5 elimination each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort.operators import cox as C
from kohort.operators.smooth import even_points, local_linear
from kohort.plans.q_scalar import SURV_SMALL_SQL, surv_small
from kohort.plans.q_summary import _pval_sql
from kohort.plans.q_survival import Z, rounded
from kohort.plans.registry import gauss_jordan_sql, register
from kohort.session import materialize

def _fit(spark, d, covs: tuple[str, ...]) -> C.CoxFit:
    return C.coxph(surv_small(spark, d), "time", "event", list(covs))


# --- SQL oracle: one 0/1 covariate, Efron ties, Newton unrolled ------------

def _s0(b: str) -> str:
    return f"(r0 + r1 * exp({b}) - (k / dt) * (d0 + d1 * exp({b})))"


def _s1(b: str) -> str:
    return f"(r1 * exp({b}) - (k / dt) * d1 * exp({b}))"


def _steps(n: int = 10) -> str:
    out = ["b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b)"]
    for i in range(1, n + 1):
        p = f"b{i - 1}.b"
        q = f"{_s1(p)} / {_s0(p)}"
        out.append(f"b{i} AS (SELECT MAX({p}) + SUM(CASE WHEN k = 0 THEN d1 ELSE 0 END - {q}) "
                   f"/ SUM({q} - ({q}) * ({q})) AS b FROM ex, b{i - 1})")
    return ",\n".join(out)


COX_BASE = "WITH " + SURV_SMALL_SQL + """,
base AS (SELECT subject_id, time AS t, CASE WHEN exposed = 'Si' THEN 1.0 ELSE 0.0 END AS x,
                CAST(event AS DOUBLE) AS e FROM surv),
pt AS (SELECT t, SUM(1 - x) AS m0, SUM(x) AS m1, SUM(e * (1 - x)) AS d0, SUM(e * x) AS d1 FROM base GROUP BY t),
rs AS (SELECT *, SUM(m0) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS r0,
                 SUM(m1) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS r1 FROM pt),
ex AS (SELECT *, d0 + d1 AS dt, unnest(range(CAST(d0 + d1 AS BIGINT))) AS k FROM rs WHERE d0 + d1 > 0),
""" + _steps(10) + f""",
fin AS (SELECT MAX(b10.b) AS b,
          SUM(CASE WHEN k = 0 THEN d1 * b10.b ELSE 0 END - ln({_s0('b10.b')})) AS ll,
          SUM({_s1('b10.b')} / {_s0('b10.b')} - ({_s1('b10.b')} / {_s0('b10.b')}) * ({_s1('b10.b')} / {_s0('b10.b')})) AS info
        FROM ex, b10),
nul AS (SELECT SUM(-ln({_s0('0.0')})) AS ll0,
          SUM(CASE WHEN k = 0 THEN d1 ELSE 0 END - {_s1('0.0')} / {_s0('0.0')}) AS u0,
          SUM({_s1('0.0')} / {_s0('0.0')} - ({_s1('0.0')} / {_s0('0.0')}) * ({_s1('0.0')} / {_s0('0.0')})) AS i0
        FROM ex),
est AS (SELECT b, 1 / sqrt(info) AS se, ll, info, ll0, u0 * u0 / i0 AS score,
               (SELECT SUM(e) FROM base) AS nev, (SELECT COUNT(*) FROM base) AS n FROM fin, nul),
haz AS (SELECT t, SUM(1 / {_s0('b')}) AS haz, SUM((1 - k / dt) / {_s0('b')}) AS hd,
               AVG({_s1('b')} / {_s0('b')}) AS xbar FROM ex, est GROUP BY t),
cum AS (SELECT rs.t, COALESCE(haz.haz, 0) AS haz, COALESCE(haz.hd, 0) AS hd, haz.xbar,
               SUM(COALESCE(haz.haz, 0)) OVER (ORDER BY rs.t ROWS UNBOUNDED PRECEDING) AS cumhaz
        FROM rs LEFT JOIN haz ON rs.t = haz.t),
res AS (SELECT base.subject_id, base.t, base.e, base.x,
               CASE WHEN base.e > 0 THEN 1 - exp(est.b * base.x) * (cum.cumhaz - cum.haz + cum.hd)
                    ELSE -exp(est.b * base.x) * (cum.cumhaz - cum.haz + cum.haz) END AS residual
        FROM base JOIN cum ON base.t = cum.t, est)"""


@register("cox_one_covariate", fixtures=("fx_surv_dates",), sql=COX_BASE + f"""
SELECT 'exposed' AS variable, 'Si' AS level, ROUND(b, 6) AS coef, ROUND(exp(b), 6) AS exp_coef,
       ROUND(se, 6) AS se, ROUND(b / se, 6) AS z, ROUND({_pval_sql('(b / se) * (b / se)', '1')}, 6) AS p_value,
       ROUND(exp(b - {Z} * se), 6) AS lower, ROUND(exp(b + {Z} * se), 6) AS upper
FROM est""")
def q_cox_one(spark, d):
    t = C.coef_table(spark, _fit(spark, d, ("exposed",)))
    return rounded(t.select("variable", "level", "coef", "exp_coef", "se", "z", "p_value", "lower", "upper"))


@register("cox_summary", fixtures=("fx_surv_dates",), sql=COX_BASE + f"""
SELECT CAST(n AS BIGINT) AS n, CAST(nev AS BIGINT) AS n_events, ROUND(ll0, 6) AS loglik_null,
       ROUND(ll, 6) AS loglik, ROUND(2 * (ll - ll0), 6) AS lr, CAST(1 AS BIGINT) AS lr_df,
       ROUND({_pval_sql('2 * (ll - ll0)', '1')}, 6) AS lr_p,
       ROUND(b * b * info, 6) AS wald, ROUND({_pval_sql('b * b * info', '1')}, 6) AS wald_p,
       ROUND(score, 6) AS score, ROUND({_pval_sql('score', '1')}, 6) AS score_p
FROM est""")
def q_cox_summary(spark, d):
    t = C.summary_table(spark, _fit(spark, d, ("exposed",)))
    return rounded(t.drop("iterations"))


@register("hazard_ratio_table", fixtures=("fx_surv_dates",), sql=COX_BASE + f"""
SELECT 'exposed' AS variable, 'No' AS level, CAST(NULL AS DOUBLE) AS hr, CAST(NULL AS DOUBLE) AS lower,
       CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS DOUBLE) AS p_value, true AS reference
UNION ALL
SELECT 'exposed', 'Si', ROUND(exp(b), 6), ROUND(exp(b - {Z} * se), 6), ROUND(exp(b + {Z} * se), 6),
       ROUND({_pval_sql('(b / se) * (b / se)', '1')}, 6), false
FROM est""")
def q_hazard_ratio_table(spark, d):
    return rounded(C.hazard_ratio_table(spark, _fit(spark, d, ("exposed",))))


@register("cox_martingale", fixtures=("fx_surv_dates",), sql=COX_BASE + """
SELECT subject_id, t AS time, CAST(e AS BIGINT) AS event, ROUND(residual, 6) AS residual FROM res""")
def q_cox_martingale(spark, d):
    fit = _fit(spark, d, ("exposed",))
    return rounded(C.martingale_residuals(fit, surv_small(spark, d), "time", "event", ["exposed"], "subject_id"))


@register("cox_schoenfeld", fixtures=("fx_surv_dates",), sql=COX_BASE + """
SELECT base.subject_id, base.t AS time, 'exposed_1' AS term, ROUND(base.x - cum.xbar, 6) AS residual
FROM base JOIN cum ON base.t = cum.t WHERE base.e > 0""")
def q_cox_schoenfeld(spark, d):
    fit = _fit(spark, d, ("exposed",))
    return rounded(C.schoenfeld_residuals(fit, surv_small(spark, d), "time", "event", ["exposed"], "subject_id"))


SMOOTH_DAYS = 120.0


def _smooth_sql(rows: str) -> str:
    """Oracle CTEs ``sm (point, fit)`` after ``rows (x, y)``: the local lines by their definition."""
    return f""",
grid AS (SELECT lo + (hi - lo) * i / 20 AS point
         FROM (SELECT CAST(MIN(x) AS DOUBLE) AS lo, CAST(MAX(x) AS DOUBLE) AS hi FROM {rows}), range(21) r(i)),
near AS (SELECT point, y, (x - point) / {SMOOTH_DAYS} AS u, pow(1 - pow(abs((x - point) / {SMOOTH_DAYS}), 3), 3) AS w
         FROM grid JOIN {rows} ON abs(x - point) < {SMOOTH_DAYS}),
mid AS (SELECT point, SUM(w * u) / SUM(w) AS um, SUM(w * y) / SUM(w) AS ym FROM near GROUP BY point),
sm AS (SELECT near.point, MAX(ym) - MAX(um) * SUM(w * (u - um) * (y - ym)) / SUM(w * (u - um) * (u - um)) AS fit
       FROM near JOIN mid ON near.point = mid.point GROUP BY near.point)"""


@register("cox_schoenfeld_smooth", fixtures=("fx_surv_dates",), sql=COX_BASE + """,
sch AS (SELECT base.t AS x, base.x - cum.xbar AS y FROM base JOIN cum ON base.t = cum.t WHERE base.e > 0)"""
          + _smooth_sql("sch") + """
SELECT 'exposed_1' AS term, ROUND(point, 6) AS point, ROUND(fit, 6) AS fit FROM sm""")
def q_cox_schoenfeld_smooth(spark, d):
    fit = _fit(spark, d, ("exposed",))
    res = materialize(C.schoenfeld_residuals(fit, surv_small(spark, d), "time", "event", ["exposed"], "subject_id"))
    return rounded(local_linear(res, "time", "residual", even_points(res, "time"), SMOOTH_DAYS, ["term"]))


@register("cox_martingale_smooth", fixtures=("fx_surv_dates",), sql=COX_BASE + """,
mar AS (SELECT t AS x, residual AS y FROM res)""" + _smooth_sql("mar") + """
SELECT ROUND(point, 6) AS point, ROUND(fit, 6) AS fit FROM sm""")
def q_cox_martingale_smooth(spark, d):
    fit = _fit(spark, d, ("exposed",))
    res = materialize(C.martingale_residuals(fit, surv_small(spark, d), "time", "event", ["exposed"], "subject_id"))
    return rounded(local_linear(res, "time", "residual", even_points(res, "time"), SMOOTH_DAYS))


@register("cox_adjusted_curves", fixtures=("fx_surv_dates",), sql=COX_BASE + """
SELECT lv.exposed, cum.t AS time, ROUND(exp(-cum.cumhaz * exp(est.b * lv.x)), 6) AS surv
FROM cum, est, (VALUES ('No', 0.0), ('Si', 1.0)) lv(exposed, x) WHERE cum.haz > 0""")
def q_cox_adjusted_curves(spark, d):
    return rounded(C.adjusted_curves(_fit(spark, d, ("exposed",)), "exposed"))


@register("cox_fit_metrics", fixtures=("fx_surv_dates",), sql=COX_BASE + """
SELECT ROUND(-2 * ll + 2, 6) AS aic, ROUND(-2 * ll + ln(nev), 6) AS bic,
       ROUND((1 - exp(2 * (ll0 - ll) / n)) / (1 - exp(2 * ll0 / n)), 6) AS r2_nagelkerke,
       ROUND(sqrt((SELECT SUM(residual * residual) FROM res) / n), 6) AS rmse
FROM est""")
def q_cox_fit_metrics(spark, d):
    return rounded(C.fit_metrics(spark, _fit(spark, d, ("exposed",))))


@register("cox_concordance", fixtures=("fx_surv_dates",), sql=COX_BASE + """,
cells AS (SELECT t, x, SUM(e) AS d, COUNT(*) AS m FROM base GROUP BY t, x),
pairs AS (SELECT i.t AS it, i.x AS ix, i.d AS id, j.t AS jt, j.x AS jx,
                 CASE WHEN j.t > i.t THEN j.m ELSE j.m - j.d END AS jn,
                 CASE WHEN i.x * est.b > j.x * est.b THEN 1 WHEN i.x * est.b < j.x * est.b THEN -1 ELSE 0 END AS cmp
          FROM cells i JOIN cells j ON j.t >= i.t, est WHERE i.d > 0),
tot AS (SELECT SUM(CASE WHEN cmp = 1 THEN id * jn ELSE 0 END) AS c, SUM(CASE WHEN cmp = -1 THEN id * jn ELSE 0 END) AS d,
               SUM(CASE WHEN cmp = 0 THEN id * jn ELSE 0 END) AS u, SUM(id * jn) AS n FROM pairs),
ends AS (SELECT it AS t, ix AS x, 1 AS dead, SUM(cmp * jn) AS s, SUM(jn) AS n FROM pairs GROUP BY it, ix
         UNION ALL SELECT jt, jx, 1, SUM(cmp * id), SUM(id) FROM pairs WHERE jt > it GROUP BY jt, jx
         UNION ALL SELECT jt, jx, 0, SUM(cmp * id), SUM(id) FROM pairs GROUP BY jt, jx),
subj AS (SELECT t, x, dead, SUM(s) AS s, SUM(n) AS n FROM ends GROUP BY t, x, dead),
jack AS (SELECT SUM((CASE WHEN dead = 1 THEN cells.d ELSE cells.m - cells.d END)
                    * POWER((subj.s - (tot.c - tot.d) / tot.n * subj.n) / (2 * tot.n), 2)) AS v
         FROM subj JOIN cells ON cells.t = subj.t AND cells.x = subj.x, tot)
SELECT CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant, CAST(u AS BIGINT) AS tied_risk,
       ROUND((c + 0.5 * u) / n, 6) AS concordance, ROUND(sqrt(v), 6) AS std_err FROM tot, jack""")
def q_cox_concordance(spark, d):
    c = C.concordance(spark, _fit(spark, d, ("exposed",)))
    return rounded(c.select(*[F.col(x).cast("bigint") for x in ("concordant", "discordant", "tied_risk")],
                            "concordance", "std_err"))


# --- SQL oracle: exposure and group, five coefficients ----------------------

N_COEF = 5   # one for the exposure, four for the five market segments
N_STEPS = 8


def _newton_step(s: int) -> str:
    """CTEs of step ``s``: risk shares at coefficients ``nb{s}``, information and score, their solution."""
    return f"""
nw{s} AS MATERIALIZED (SELECT p, exp(SUM(x * b)) AS w FROM nx JOIN nb{s} USING (j) GROUP BY p),
nu{s} AS MATERIALIZED (SELECT t, k, p, w * q / SUM(w * q) OVER (PARTITION BY t, k) AS u FROM nex JOIN nw{s} USING (p)),
ne{s} AS MATERIALIZED (SELECT t, k, j, SUM(x * u) AS e FROM nu{s} JOIN nx USING (p) GROUP BY t, k, j),
nm{s}_0 AS MATERIALIZED (SELECT i, j, SUM(v) AS v FROM (
  SELECT a.j AS i, b.j AS j, a.x * b.x * g.u AS v
  FROM (SELECT p, SUM(u) AS u FROM nu{s} GROUP BY p) g JOIN nx a ON a.p = g.p JOIN nx b ON b.p = g.p
  UNION ALL SELECT a.j, b.j, -a.e * b.e FROM ne{s} a JOIN ne{s} b ON a.t = b.t AND a.k = b.k
  UNION ALL SELECT j, 0, x * d FROM ncell JOIN nx USING (p)
  UNION ALL SELECT j, 0, -e FROM ne{s}
  UNION ALL SELECT a.j, 100 + b.j, CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END FROM nterm a, nterm b) z GROUP BY i, j),
{gauss_jordan_sql(f"nm{s}", N_COEF)},
nb{s + 1} AS MATERIALIZED (SELECT b.j, b.b + m.v AS b FROM nb{s} b JOIN nm{s}_{N_COEF} m ON m.i = b.j AND m.j = 0)"""


COX_TWO = f""",
nlv AS (SELECT 'exposed' AS variable, exposed AS level FROM surv UNION SELECT 'grp', grp FROM surv),
nterm AS (SELECT *, ROW_NUMBER() OVER (ORDER BY variable, level) AS j FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY level) - 1 AS pos FROM nlv) l WHERE pos > 0),
npat AS (SELECT *, ROW_NUMBER() OVER (ORDER BY exposed, grp) AS p FROM (SELECT DISTINCT exposed, grp FROM surv) x),
nx AS MATERIALIZED (SELECT p, j, CASE WHEN level = (CASE WHEN variable = 'grp' THEN grp ELSE exposed END) THEN 1.0 ELSE 0.0 END AS x
                    FROM npat, nterm),
ncell AS MATERIALIZED (SELECT time AS t, p, CAST(SUM(event) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS m
                       FROM surv JOIN npat ON surv.exposed = npat.exposed AND surv.grp = npat.grp GROUP BY time, p),
ntt AS (SELECT t, SUM(d) AS dt FROM ncell GROUP BY t HAVING SUM(d) > 0),
nrisk AS (SELECT ntt.t, ntt.dt, c.p, SUM(c.m) AS r, SUM(CASE WHEN c.t = ntt.t THEN c.d ELSE 0 END) AS d
          FROM ntt JOIN ncell c ON c.t >= ntt.t GROUP BY ntt.t, ntt.dt, c.p),
nk AS (SELECT t, dt, unnest(range(CAST(dt AS BIGINT))) AS k FROM ntt),
nex AS MATERIALIZED (SELECT nk.t, nk.k, nrisk.p, nrisk.r - (nk.k / nk.dt) * nrisk.d AS q FROM nrisk JOIN nk ON nk.t = nrisk.t),
nb0 AS (SELECT j, CAST(0.0 AS DOUBLE) AS b FROM nterm),""" + ",".join(_newton_step(s) for s in range(N_STEPS)) + f""",
nwf AS MATERIALIZED (SELECT p, exp(SUM(x * b)) AS w FROM nx JOIN nb{N_STEPS} USING (j) GROUP BY p),
nll AS (SELECT (SELECT SUM(d * ln(w)) FROM ncell JOIN nwf USING (p))
             - (SELECT SUM(ln(s)) FROM (SELECT SUM(w * q) AS s FROM nex JOIN nwf USING (p) GROUP BY t, k) y) AS ll),
nest AS (SELECT nterm.*, nb{N_STEPS}.b, sqrt(m.v) AS se FROM nterm JOIN nb{N_STEPS} ON nb{N_STEPS}.j = nterm.j
         JOIN nm{N_STEPS - 1}_{N_COEF} m ON m.i = nterm.j AND m.j = 100 + nterm.j)"""


@register("cox_two_covariates", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + COX_TWO + f"""
SELECT variable, variable || '_' || pos AS term, level, ROUND(b, 6) AS coef, ROUND(exp(b), 6) AS exp_coef,
       ROUND(se, 6) AS se, ROUND(b / se, 6) AS z, ROUND({_pval_sql('(b / se) * (b / se)', '1')}, 6) AS p_value,
       ROUND(exp(b - {Z} * se), 6) AS lower, ROUND(exp(b + {Z} * se), 6) AS upper
FROM nest""")
def q_cox_two(spark, d):
    t = C.coef_table(spark, _fit(spark, d, ("exposed", "grp")))
    return rounded(t)


@register("cox_nested_test", fixtures=("fx_surv_dates",), sql=COX_BASE + COX_TWO + f"""
SELECT ROUND(est.ll, 6) AS loglik_reduced, ROUND(nll.ll, 6) AS loglik_full, ROUND(2 * (nll.ll - est.ll), 6) AS chisq,
       CAST({N_COEF - 1} AS BIGINT) AS df, ROUND({_pval_sql('2 * (nll.ll - est.ll)', str(N_COEF - 1))}, 6) AS p_value
FROM est, nll""")
def q_cox_nested(spark, d):
    full = _fit(spark, d, ("exposed", "grp"))
    reduced = C.drop_term(surv_small(spark, d), "time", "event", full, ["exposed", "grp"], "grp")
    return rounded(C.nested_test(spark, full, reduced))
