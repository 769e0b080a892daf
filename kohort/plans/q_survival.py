"""Registered queries: survival curves and log-rank tests (K1-K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions import dates as D
from kohort.operators import survival as S
from kohort.operators.interval import km_interval
from kohort.plans import fixtures as fx
from kohort.plans.q_scalar import ENTRY_EXIT_SQL, STUDY_START, SURV_SMALL_SQL, entry_exit, surv_small
from kohort.plans.registry import gauss_jordan_sql, register
from kohort.sources.io import table

Z = "1.959963984540054"
BIG_ORIGIN, BIG_END = "1995-01-01", "1998-12-31"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (result tables are compared by value)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def surv_big(spark, d):
    """FX-SURV-BIG as (subject, grp, time, event)."""
    s = fx.fx_surv_big_dates(spark, d)
    ev = F.when(F.col("event_date").isNotNull(), 1).otherwise(0)
    return s.select("subject_id", "grp",
                    D.time_to_event(ev, "event_date", BIG_ORIGIN, BIG_END).alias("time"),
                    ev.cast("bigint").alias("event"))


SURV_BIG_SQL = f"""
surv AS (
  SELECT subject_id, grp,
    CAST(CASE WHEN event_date IS NULL THEN DATE '{BIG_END}' - DATE '{BIG_ORIGIN}'
              ELSE event_date - DATE '{BIG_ORIGIN}' END AS BIGINT) AS time,
    CAST(CASE WHEN event_date IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS event
  FROM fx_surv_big_dates)"""


def km_sql(by: str | None, extra: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel_by = f"{by}, " if by else ""
    grp_by = f"{by}, " if by else ""
    return f""",
c AS (SELECT {sel_by}time AS t, CAST(SUM(event) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS m
      FROM surv GROUP BY {grp_by}time),
r AS (SELECT *, SUM(m) OVER ({part} ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM c),
k AS (SELECT *,
        PRODUCT(CASE WHEN n > 0 THEN 1 - d / n ELSE 1 END)
          OVER ({part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surv,
        SUM(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0 END)
          OVER ({part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gw
      FROM r)
SELECT {sel_by}t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
       CAST(m - d AS BIGINT) AS n_censor, ROUND(surv, 6) AS surv{extra}
FROM k"""


CONF_COLS = f""",
       ROUND(surv * sqrt(gw), 6) AS std_err,
       ROUND(CASE WHEN surv > 0 THEN surv * exp(-{Z} * sqrt(gw)) END, 6) AS lower,
       ROUND(CASE WHEN surv > 0 THEN LEAST(1.0, surv * exp({Z} * sqrt(gw))) END, 6) AS upper"""


@register("km_overall", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + km_sql(None))
def q_km_overall(spark, d):
    km = S.kaplan_meier(surv_small(spark, d), "time", "event")
    return rounded(km.select("time", "n_risk", "n_event", "n_censor", "surv"))


@register("km_by_group", fixtures=("fx_surv_big_dates",), sql="WITH " + SURV_BIG_SQL + km_sql("grp"))
def q_km_by_group(spark, d):
    km = S.kaplan_meier(surv_big(spark, d), "time", "event", by=["grp"])
    return rounded(km.select("grp", "time", "n_risk", "n_event", "n_censor", "surv"))


@register("km_confint", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + km_sql("exposed", CONF_COLS))
def q_km_confint(spark, d):
    km = S.kaplan_meier(surv_small(spark, d), "time", "event", by=["exposed"])
    return rounded(km.select("exposed", "time", "n_risk", "n_event", "n_censor", "surv",
                             "std_err", "lower", "upper"))


def _median_sql() -> str:
    base = km_sql("grp", CONF_COLS)
    body = base[base.index("c AS"):base.index("SELECT grp, t AS time")]
    return "WITH " + SURV_BIG_SQL + ",\n" + body + f"""
, kk AS (SELECT grp, t, surv,
           CASE WHEN surv > 0 THEN surv * exp(-{Z} * sqrt(gw)) END AS lo,
           CASE WHEN surv > 0 THEN LEAST(1.0, surv * exp({Z} * sqrt(gw))) END AS hi
         FROM k WHERE d > 0),
med AS (SELECT grp,
          MIN(CASE WHEN surv <= 0.5 + 1e-12 THEN t END) AS m,
          MIN(CASE WHEN abs(surv - 0.5) <= 1e-12 THEN t END) AS flat,
          MIN(CASE WHEN surv < 0.5 - 1e-12 THEN t END) AS after,
          MIN(CASE WHEN lo <= 0.5 + 1e-12 THEN t END) AS lci,
          MIN(CASE WHEN hi <= 0.5 + 1e-12 THEN t END) AS uci
        FROM kk GROUP BY grp),
cnt AS (SELECT grp, CAST(COUNT(*) AS BIGINT) AS records, CAST(SUM(event) AS BIGINT) AS events FROM surv GROUP BY grp)
SELECT cnt.grp, records, events,
  ROUND(CASE WHEN flat IS NOT NULL AND after IS NOT NULL THEN (flat + after) / 2.0 ELSE CAST(m AS DOUBLE) END, 6) AS median,
  ROUND(CAST(lci AS DOUBLE), 6) AS lower_ci, ROUND(CAST(uci AS DOUBLE), 6) AS upper_ci
FROM cnt LEFT JOIN med ON cnt.grp = med.grp"""


@register("km_median", fixtures=("fx_surv_big_dates",), sql=_median_sql())
def q_km_median(spark, d):
    s = surv_big(spark, d)
    km = S.kaplan_meier(s, "time", "event", by=["grp"])
    return rounded(S.km_summary(km, by=["grp"]))


@register("km_curve_points", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + km_sql("grp", """,
       ROUND(CASE WHEN surv > 0 THEN surv * exp(-1.959963984540054 * sqrt(gw)) END, 6) AS lower,
       ROUND(CASE WHEN surv > 0 THEN LEAST(1.0, surv * exp(1.959963984540054 * sqrt(gw))) END, 6) AS upper,
       surv >= 0.75 - 1e-12 AND surv <= 1.0 + 1e-12 AS in_window""").replace("FROM k", """FROM k
UNION ALL
SELECT grp, CAST(0 AS BIGINT), CAST(COUNT(*) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
       1.0, 1.0, 1.0, true FROM surv GROUP BY grp"""))
def q_km_curve_points(spark, d):
    s = surv_small(spark, d)
    km = S.kaplan_meier(s, "time", "event", by=["grp"])
    return rounded(S.curve_points(km, by=["grp"], ylim=(0.75, 1.0)))


RISK_TIMES = [0, 365, 730, 1095, 1460]


@register("risk_table", fixtures=("fx_surv_big_dates",), sql="WITH " + SURV_BIG_SQL + ",\nb(bt) AS (VALUES " +
          ", ".join(f"({t})" for t in RISK_TIMES) + """)
SELECT grp, CAST(bt AS BIGINT) AS time, CAST(SUM(CASE WHEN time >= bt THEN 1 ELSE 0 END) AS BIGINT) AS n_risk
FROM surv, b GROUP BY grp, bt""")
def q_risk_table(spark, d):
    return S.risk_table(surv_big(spark, d), "time", "event", RISK_TIMES, by=["grp"])


@register("km_delayed_entry", fixtures=("fx_entry",), sql=ENTRY_EXIT_SQL + f""",
b AS (SELECT CAST(entry_date - DATE '{STUDY_START}' AS BIGINT) AS s,
             CAST(exit_date - DATE '{STUDY_START}' AS BIGINT) AS x, event AS e
      FROM ee WHERE entry_date IS NOT NULL AND exit_date IS NOT NULL
        AND exit_date - DATE '{STUDY_START}' > entry_date - DATE '{STUDY_START}'),
ev AS (SELECT t, SUM(n_in) AS n_in, SUM(n_out) AS n_out, SUM(n_event) AS n_event FROM (
         SELECT s AS t, 1 AS n_in, 0 AS n_out, 0 AS n_event FROM b
         UNION ALL SELECT x, 0, 1, e FROM b) u GROUP BY t),
r AS (SELECT *, SUM(n_in) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) - n_in
               - (SUM(n_out) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) - n_out) AS n FROM ev),
k AS (SELECT *, PRODUCT(CASE WHEN n > 0 THEN 1 - CAST(n_event AS DOUBLE) / n ELSE 1 END)
                  OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS surv FROM r WHERE n_out > 0)
SELECT t AS time, CAST(n AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event,
       CAST(n_out - n_event AS BIGINT) AS n_censor, ROUND(surv, 6) AS surv FROM k""")
def q_km_delayed_entry(spark, d):
    ee = entry_exit(spark, d).select(
        D.days_between(STUDY_START, "entry_date").alias("start"),
        D.days_between(STUDY_START, "exit_date").alias("stop"), "event")
    return rounded(S.km_delayed_entry(ee, "start", "stop", "event"))


def _pval_sql(x2: str, df: str) -> str:
    return (f"CASE WHEN {x2} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 300), lambda kk: "
            f"exp(-({x2}) / 2 + ({df} / 2.0 + kk) * ln(({x2}) / 2) - lgamma({df} / 2.0 + kk + 1)))) END")


def _logrank_sql(by: str, with_test: bool) -> str:
    test = ""
    if with_test:
        test = (",\n  ROUND(x2, 6) AS chisq, CAST(1 AS BIGINT) AS df, ROUND(" + _pval_sql("x2", "1") + ", 6) AS p_value")
    return f""",
c AS (SELECT {by} AS g, time AS t, CAST(SUM(event) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS m
      FROM surv GROUP BY {by}, time),
lv AS (SELECT DISTINCT g FROM c), tt AS (SELECT DISTINCT t FROM c),
grid AS (SELECT lv.g, tt.t, COALESCE(c.d, 0) AS d, COALESCE(c.m, 0) AS m
         FROM lv CROSS JOIN tt LEFT JOIN c ON c.g = lv.g AND c.t = tt.t),
r AS (SELECT *, SUM(m) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS r FROM grid),
x AS (SELECT *, SUM(r) OVER (PARTITION BY t) AS n, SUM(d) OVER (PARTITION BY t) AS dd FROM r),
s AS (SELECT g, SUM(m) AS n_sub, SUM(d) AS o, SUM(dd * r / n) AS e,
             SUM(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) ELSE 0 END * (r / n) * (1 - r / n)) AS v
      FROM x GROUP BY g),
f AS (SELECT *, (SELECT (o - e) * (o - e) / v FROM s ORDER BY g LIMIT 1) AS x2 FROM s)
SELECT g AS {by}, CAST(n_sub AS BIGINT) AS n, ROUND(o, 6) AS observed, ROUND(e, 6) AS expected,
  ROUND(CASE WHEN e > 0 THEN (o - e) * (o - e) / e END, 6) AS oe2_e,
  ROUND(CASE WHEN v > 0 THEN (o - e) * (o - e) / v END, 6) AS oe2_v{test}
FROM f"""


@register("logrank_two_group", fixtures=("fx_surv_dates",),
          sql="WITH " + SURV_SMALL_SQL + _logrank_sql("exposed", True))
def q_logrank_two_group(spark, d):
    return rounded(S.logrank_test(surv_small(spark, d), "time", "event", "exposed"))


@register("logrank_k_group", fixtures=("fx_surv_dates",),
          sql="WITH " + SURV_SMALL_SQL + _logrank_sql("grp", False))
def q_logrank_k_group(spark, d):
    t = S.logrank_test(surv_small(spark, d), "time", "event", "grp")
    return rounded(t.drop("chisq", "df", "p_value"))


N_GROUPS = 5  # market segments
_GRID_SQL = _logrank_sql("grp", False)
_GRID_SQL = _GRID_SQL[:_GRID_SQL.index(",\nf AS")]


@register("logrank_k_group_test", fixtures=("fx_surv_dates",), sql="WITH " + SURV_SMALL_SQL + _GRID_SQL + f""",
ix AS (SELECT g, ROW_NUMBER() OVER (ORDER BY g) AS i FROM lv),
y AS (SELECT ix.i, x.t, x.r, x.n, CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) ELSE 0 END AS w FROM x JOIN ix ON ix.g = x.g),
m_0 AS MATERIALIZED (
  SELECT a.i, b.i AS j, SUM(a.w * (CASE WHEN a.i = b.i THEN a.r / a.n ELSE 0 END - a.r * b.r / (a.n * a.n))) AS v
  FROM y a JOIN y b ON a.t = b.t WHERE a.i < {N_GROUPS} AND b.i < {N_GROUPS} GROUP BY a.i, b.i
  UNION ALL SELECT ix.i, 0, s.o - s.e FROM s JOIN ix ON ix.g = s.g WHERE ix.i < {N_GROUPS}),
{gauss_jordan_sql("m", N_GROUPS - 1)},
st AS (SELECT SUM(a.v * b.v) AS x2 FROM m_0 a JOIN m_{N_GROUPS - 1} b ON a.i = b.i AND a.j = 0 AND b.j = 0)
SELECT g AS grp, ROUND(x2, 6) AS chisq, CAST({N_GROUPS - 1} AS BIGINT) AS df,
       ROUND({_pval_sql("x2", str(N_GROUPS - 1))}, 6) AS p_value FROM lv, st""")
def q_logrank_k_group_test(spark, d):
    """k-group chi-square: a (k-1)x(k-1) solve."""
    t = S.logrank_test(surv_small(spark, d), "time", "event", "grp")
    return rounded(t.select("grp", "chisq", "df", "p_value"))


@register("km_delayed_entry_excluded", fixtures=("fx_entry",), sql=ENTRY_EXIT_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(CASE WHEN exit_date <= entry_date THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded
FROM ee WHERE entry_date IS NOT NULL AND exit_date IS NOT NULL""")
def q_km_delayed_entry_excluded(spark, d):
    ee = entry_exit(spark, d).select(
        D.days_between(STUDY_START, "entry_date").alias("start"),
        D.days_between(STUDY_START, "exit_date").alias("stop"))
    return S.delayed_entry_excluded(ee, "start", "stop")


# Days from an order to its full shipment, known to lie between its first and last shipping date; open to the right
# for orders still open, and known at the last date only for urgent ones.
INTERVAL_SQL = """
WITH x AS (
  SELECT CASE WHEN MIN(o_orderpriority) = '1-URGENT' THEN NULL
              ELSE CAST(MIN(l_shipdate) AS DATE) - CAST(MIN(o_orderdate) AS DATE) END AS l,
         CASE WHEN MIN(o_orderstatus) = 'O' THEN NULL
              ELSE CAST(MAX(l_shipdate) AS DATE) - CAST(MIN(o_orderdate) AS DATE) END AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def _interval_sql(steps: int = 10) -> str:
    sql = INTERVAL_SQL + """,
d AS (SELECT CASE WHEN l IS NULL THEN -1000000000 WHEN l = r THEN 2 * l ELSE 2 * l + 1 END AS lo,
             COALESCE(2 * r, 1000000000) AS hi, CAST(COUNT(*) AS DOUBLE) AS n
      FROM x WHERE (l IS NOT NULL OR r IS NOT NULL) AND (l IS NULL OR r IS NULL OR l <= r) GROUP BY 1, 2),
e AS (SELECT DISTINCT pt, kind FROM (SELECT lo AS pt, 0 AS kind FROM d UNION ALL SELECT hi, 1 FROM d) u),
q AS (SELECT kind, pt AS lo, LEAD(kind) OVER (ORDER BY pt, kind) AS k2, LEAD(pt) OVER (ORDER BY pt, kind) AS hi FROM e),
i AS MATERIALIZED (SELECT lo, hi FROM q WHERE kind = 0 AND k2 = 1),
h AS MATERIALIZED (SELECT d.lo AS dl, d.hi AS dh, d.n, i.lo, i.hi FROM d JOIN i ON d.lo <= i.lo AND i.hi <= d.hi),
p0 AS MATERIALIZED (SELECT lo, hi, 1.0 / COUNT(*) OVER () AS p FROM i)"""
    for k in range(1, steps + 1):
        sql += f""",
m{k} AS MATERIALIZED (SELECT dl, dh, SUM(p) AS mass FROM h JOIN p{k - 1} USING (lo, hi) GROUP BY dl, dh),
p{k} AS MATERIALIZED (SELECT lo, hi, p{k - 1}.p * SUM(h.n / mass) / (SELECT SUM(n) FROM d) AS p
       FROM h JOIN m{k} USING (dl, dh) JOIN p{k - 1} USING (lo, hi) GROUP BY lo, hi, p{k - 1}.p)"""
    return sql + f"""
SELECT CASE WHEN lo > -1000000000 THEN CAST(floor(lo / 2.0) AS BIGINT) END AS time_left,
       CASE WHEN hi < 1000000000 THEN CAST(hi / 2 AS BIGINT) END AS time_right,
       lo % 2 = 0 AND lo > -1000000000 AS exact, ROUND(p, 6) AS mass,
       ROUND(GREATEST(0, 1 - SUM(p) OVER (ORDER BY lo)), 6) AS surv FROM p{steps}"""


@register("km_interval", sql=_interval_sql())
def q_km_interval(spark, d):
    days = lambda c: F.datediff(F.col(c).cast("date"), F.col("o_orderdate").cast("date"))
    ships = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    j = table(spark, d, "orders").join(ships, F.expr("l_orderkey = o_orderkey"))
    x = j.select(F.when(F.col("o_orderpriority") != "1-URGENT", days("first")).alias("l"),
                 F.when(F.col("o_orderstatus") != "O", days("last")).alias("r"))
    return rounded(km_interval(x, "l", "r", max_iter=10, tol=0.0))
