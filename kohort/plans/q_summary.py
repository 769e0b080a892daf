"""Registered queries: missingness, summaries, crosstabs, tests (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohort.operators import assoc as A
from kohort.operators import summary as SM
from kohort.operators.exact import fisher_rxc
from kohort.plans import fixtures as fx
from kohort.plans.q_survival import _pval_sql, rounded
from kohort.plans.registry import register
from kohort.sources.io import table

REC_COLS = ["subject_id", "record_id", "dx_date", "birth_date", "code", "stage", "ecog_txt", "ecog", "morph"]


def _grade_sql(r: str) -> str:
    return "CASE " + " ".join(f"WHEN {r} <= {hi} THEN '{name}'" for name, hi in SM.NA_GRADES) + " END"


@register("na_pareto", fixtures=("fx_rec",), sql="""
WITH m AS (SELECT COUNT(*) AS n, """ + ", ".join(f"COUNT(*) - COUNT({c}) AS m_{c}" for c in REC_COLS) + """ FROM fx_rec),
l AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS variable, m_{c} AS n_missing, n FROM m" for c in REC_COLS) + """)
SELECT variable, CAST(n_missing AS BIGINT) AS n_missing, ROUND(n_missing / n, 6) AS ratio,
  ROUND(SUM(n_missing) OVER (ORDER BY n_missing DESC, variable ROWS UNBOUNDED PRECEDING) * 100.0
        / SUM(n_missing) OVER (), 6) AS cumulative,
  """ + _grade_sql("n_missing / n") + """ AS grade
FROM l WHERE n_missing > 0""")
def q_na_pareto(spark, d):
    return rounded(SM.na_pareto(fx.fx_rec(spark, d)))


def _cat_sql(src: str, cols: list[str], missing: bool) -> str:
    where = "" if missing else " WHERE {c} IS NOT NULL"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, COUNT(*) AS n FROM {src}"
        + where.format(c=c) + " GROUP BY 2" for c in cols)
    return f"""
SELECT variable, level, CAST(n AS BIGINT) AS n,
  ROUND(CASE WHEN level IS NOT NULL THEN n * 100.0 / SUM(CASE WHEN level IS NOT NULL THEN n END)
                                              OVER (PARTITION BY variable) END, 6) AS pct
FROM ({parts}) t"""


@register("summary_categorical", sql=_cat_sql("orders", ["o_orderstatus", "o_orderpriority"], False))
def q_summary_categorical(spark, d):
    return rounded(SM.summary_categorical(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@register("summary_with_missing", fixtures=("fx_rec",), sql=_cat_sql("fx_rec", ["stage", "ecog_txt"], True))
def q_summary_with_missing(spark, d):
    return rounded(SM.summary_categorical(fx.fx_rec(spark, d), ["stage", "ecog_txt"], missing=True))


def _q2(p: float) -> str:
    np_ = f"(n * {p})"
    return (f"AVG(CASE WHEN ({np_} - floor({np_}) > 0 AND pos = floor({np_})) "
            f"OR ({np_} - floor({np_}) = 0 AND pos IN (floor({np_}) - 1, floor({np_}))) THEN value END)")


def _cont_sql(src: str, cols: list[str], by: str | None = None) -> str:
    keep = f"{by}, " if by else ""
    part = f"PARTITION BY {by}, variable" if by else "PARTITION BY variable"
    u = " UNION ALL ".join(f"SELECT {keep}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)
    return f"""
WITH u AS ({u}),
v AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY value) - 1 AS pos, COUNT(*) OVER ({part}) AS n
      FROM u WHERE value IS NOT NULL)
SELECT {keep}variable, CAST(MAX(n) AS BIGINT) AS n, ROUND({_q2(0.5)}, 6) AS median,
       ROUND({_q2(0.25)}, 6) AS q1, ROUND({_q2(0.75)}, 6) AS q3
FROM v GROUP BY {keep}variable"""


@register("summary_continuous", sql=_cont_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def q_summary_continuous(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(SM.summary_continuous(li, ["l_quantity", "l_extendedprice", "l_discount"]))


@register("continuous_by_group", sql=_cont_sql("lineitem", ["l_quantity", "l_extendedprice"], "l_linestatus"))
def q_continuous_by_group(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(SM.summary_continuous(li, ["l_quantity", "l_extendedprice"], by=["l_linestatus"]))


PERIOD_SQL = "CASE WHEN o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'early' ELSE 'late' END"


def orders_period(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("period", F.when(F.col("o_orderdate") < F.lit("1997-01-01 00:00:00")
                                         .cast("timestamp_ntz"), "early").otherwise("late"))


def _xtab_sql(percent: str) -> str:
    part = "variable, level" if percent == "row" else "variable, period"
    return f"""
WITH o AS (SELECT *, {PERIOD_SQL} AS period FROM orders),
c AS (SELECT 'o_orderstatus' AS variable, o_orderstatus AS level, period, COUNT(*) AS n FROM o GROUP BY 2, 3
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, period, COUNT(*) FROM o GROUP BY 2, 3)
SELECT variable, level, period, CAST(n AS BIGINT) AS n,
       ROUND(n * 100.0 / SUM(n) OVER (PARTITION BY {part}), 6) AS pct FROM c"""


@register("crosstab_row_pct", sql=_xtab_sql("row"))
def q_crosstab_row(spark, d):
    return rounded(SM.crosstab(orders_period(spark, d), ["o_orderstatus", "o_orderpriority"], "period", "row"))


@register("crosstab_col_pct", sql=_xtab_sql("col"))
def q_crosstab_col(spark, d):
    return rounded(SM.crosstab(orders_period(spark, d), ["o_orderstatus", "o_orderpriority"], "period", "col"))


def _chi2_sql(src: str, var: str, by: str) -> str:
    return f"""
SELECT '{var}' AS variable, SUM((o - e) * (o - e) / e) AS statistic,
       CAST((COUNT(DISTINCT level) - 1) * (COUNT(DISTINCT g) - 1) AS BIGINT) AS df,
       MIN(e) AS min_expected, CAST(MAX(n) AS BIGINT) AS n
FROM (SELECT rt.level, ct.g, COALESCE(cell.o, 0) AS o, rt.r * ct.c / tot.n AS e, tot.n
      FROM (SELECT CAST({var} AS VARCHAR) AS level, COUNT(*) AS r FROM {src} WHERE {var} IS NOT NULL AND {by} IS NOT NULL GROUP BY 1) rt
      CROSS JOIN (SELECT CAST({by} AS VARCHAR) AS g, COUNT(*) AS c FROM {src} WHERE {var} IS NOT NULL AND {by} IS NOT NULL GROUP BY 1) ct
      CROSS JOIN (SELECT COUNT(*) AS n FROM {src} WHERE {var} IS NOT NULL AND {by} IS NOT NULL) tot
      LEFT JOIN (SELECT CAST({var} AS VARCHAR) AS level, CAST({by} AS VARCHAR) AS g, COUNT(*) AS o
                 FROM {src} WHERE {var} IS NOT NULL AND {by} IS NOT NULL GROUP BY 1, 2) cell
        ON cell.level = rt.level AND cell.g = ct.g) x"""


def _with_p(inner: str, stat: str = "statistic", df: str = "df") -> str:
    return f"SELECT *, {_pval_sql(stat, df)} AS p_value FROM ({inner}) q"


def _round_all(inner: str, cols: list[str], dbl: list[str]) -> str:
    sel = ", ".join(f"ROUND({c}, 6) AS {c}" if c in dbl else c for c in cols)
    return f"SELECT {sel} FROM ({inner}) r"


@register("chi2_independence", sql=_round_all(_with_p(_chi2_sql("orders", "o_orderstatus", "o_orderpriority")),
          ["variable", "statistic", "df", "min_expected", "n", "p_value"], ["statistic", "min_expected", "p_value"]))
def q_chi2(spark, d):
    t = A.chi2_test(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")
    return rounded(t.select("variable", "statistic", "df", "min_expected", "n", "p_value"))


@register("fisher_exact_2x2", sql="""
WITH c AS (SELECT
    SUM(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS a,
    SUM(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS b,
    SUM(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS c,
    SUM(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS d FROM labels
    WHERE quality IS NOT NULL AND toxic IS NOT NULL),
m AS (SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d,
             CAST(a + b AS DOUBLE) AS r1, CAST(a + c AS DOUBLE) AS c1, CAST(a + b + c + d AS DOUBLE) AS n FROM c),
s AS (SELECT m.*, x.x FROM m, (SELECT unnest(range(0, 100000)) AS x) x
      WHERE x.x >= greatest(0, r1 + c1 - n) AND x.x <= least(r1, c1)),
p AS (SELECT a, b, c, d,
        lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1)
      + lgamma(n - r1 + 1) - lgamma(c1 - x + 1) - lgamma(n - r1 - c1 + x + 1)
      - (lgamma(n + 1) - lgamma(c1 + 1) - lgamma(n - c1 + 1)) AS lp,
        lgamma(r1 + 1) - lgamma(a + 1) - lgamma(r1 - a + 1)
      + lgamma(n - r1 + 1) - lgamma(c1 - a + 1) - lgamma(n - r1 - c1 + a + 1)
      - (lgamma(n + 1) - lgamma(c1 + 1) - lgamma(n - c1 + 1)) AS lobs FROM s)
SELECT 'quality' AS variable, a, b, c, d,
       ROUND(LEAST(1.0, SUM(CASE WHEN lp <= lobs + ln(1 + 1e-7) THEN exp(lp) ELSE 0 END)), 6) AS p_value
FROM p GROUP BY a, b, c, d""")
def q_fisher(spark, d):
    return rounded(A.fisher_2x2(table(spark, d, "labels"), ["quality"], "toxic"))


def _ranksum_sql(src: str, var: str, by: str) -> str:
    return f"""
SELECT '{var}' AS variable, w AS statistic, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       (w - n1 * n2 / 2.0 - sign(w - n1 * n2 / 2.0) * 0.5)
       / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
FROM (SELECT r1 - n1 * (n1 + 1) / 2.0 AS w, n1, n2, ties FROM (
  SELECT SUM(t1 * rk) AS r1, CAST(SUM(t1) AS DOUBLE) AS n1, CAST(SUM(t) - SUM(t1) AS DOUBLE) AS n2,
         CAST(SUM(t * t * t - t) AS DOUBLE) AS ties
  FROM (SELECT *, SUM(t) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0 AS rk
        FROM (SELECT CAST({var} AS DOUBLE) AS value, COUNT(*) AS t,
                     SUM(CASE WHEN CAST({by} AS VARCHAR) = (SELECT MIN(CAST({by} AS VARCHAR)) FROM {src}
                                                           WHERE {var} IS NOT NULL AND {by} IS NOT NULL)
                         THEN 1 ELSE 0 END) AS t1
              FROM {src} WHERE {var} IS NOT NULL AND {by} IS NOT NULL GROUP BY 1) c) r) s) w"""


def _ranksum_full(src, var, by):
    inner = _ranksum_sql(src, var, by)
    return f"SELECT *, {_pval_sql('z * z', '1')} AS p_value FROM ({inner}) q"


@register("rank_sum", sql=_round_all(_ranksum_full("lineitem", "l_quantity", "l_linestatus"),
          ["variable", "statistic", "n1", "n2", "z", "p_value"], ["statistic", "z", "p_value"]))
def q_rank_sum(spark, d):
    return rounded(A.rank_sum_test(table(spark, d, "lineitem"), ["l_quantity"], "l_linestatus"))


# Balances at either end are rare, so their expected counts call for an exact test.
_RARE_FIXTURE = """x AS (SELECT
    CASE r_name WHEN 'AMERICA' THEN 'a' WHEN 'ASIA' THEN 'b' ELSE 'c' END AS grp,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'w' WHEN 'MACHINERY' THEN 'w' WHEN 'FURNITURE' THEN 'x'
                      WHEN 'HOUSEHOLD' THEN 'y' ELSE 'z' END AS segment,
    CASE WHEN c_acctbal < -950 THEN 'low' WHEN c_acctbal > 9950 THEN 'top' ELSE 'mid' END AS band,
    CASE WHEN c_acctbal > 9940 THEN 'top' ELSE 'rest' END AS rare
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def rare_balances(spark, d):
    j = (table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
         .join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")))
    return j.select(
        F.expr("CASE r_name WHEN 'AMERICA' THEN 'a' WHEN 'ASIA' THEN 'b' ELSE 'c' END").alias("grp"),
        F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'w' WHEN 'MACHINERY' THEN 'w' WHEN 'FURNITURE' THEN 'x' "
               "WHEN 'HOUSEHOLD' THEN 'y' ELSE 'z' END").alias("segment"),
        F.expr("CASE WHEN c_acctbal < -950 THEN 'low' WHEN c_acctbal > 9950 THEN 'top' ELSE 'mid' END").alias("band"),
        F.expr("CASE WHEN c_acctbal > 9940 THEN 'top' ELSE 'rest' END").alias("rare"))


def _rxc_sql(var: str, by: str, groups: str, free: list[str], rest: str) -> str:
    """All tables with the observed margins: the levels ``free`` take every filling of the groups, ``rest`` what is left."""
    k, levels = len(groups), [*free, rest]
    n = lambda lv, g: f"n_{lv}_{g}"
    counts = ",\n    ".join(f"CAST(COUNT(*) FILTER ({var} = '{lv}' AND {by} = '{g}') AS BIGINT) AS {n(lv, g)}" for lv in levels for g in groups)
    sql = f"WITH {_RARE_FIXTURE},\no AS (SELECT {counts} FROM x),\nt0 AS (SELECT * FROM o)"
    step = 0
    for lv in free:
        whole = " + ".join(n(lv, g) for g in groups)
        for i, g in enumerate(groups[:-1]):
            used = " + ".join([f"y_{lv}_{h}" for h in groups[:i]] or ["0"])
            step += 1
            sql += (f",\nt{step} AS (SELECT *, unnest(range(0, {whole} - ({used}) + 1)) AS y_{lv}_{g} FROM t{step - 1})")
        step += 1
        sql += f",\nt{step} AS (SELECT *, {whole} - ({' + '.join(f'y_{lv}_{h}' for h in groups[:-1])}) AS y_{lv}_{groups[-1]} FROM t{step - 1})"
    left = ", ".join(f"{' + '.join(n(lv, g) for lv in levels)} - ({' + '.join(f'y_{lv}_{g}' for lv in free)}) AS y_{rest}_{g}" for g in groups)
    fits = " AND ".join(f"y_{rest}_{g} >= 0" for g in groups)
    cells = [(lv, g) for lv in levels for g in groups]
    log = lambda c: " - ".join(["0"] + [f"lgamma({c}_{lv}_{g} + 1)" for lv, g in cells])
    return sql + f""",
z AS (SELECT * FROM (SELECT *, {left} FROM t{step}) q WHERE {fits}),
w AS (SELECT {log('y')} AS lw, {log('n')} AS lobs, {' + '.join(n(*c) for c in cells)} AS n FROM z),
s AS (SELECT *, exp(lw - MAX(lw) OVER ()) AS p FROM w)
SELECT '{var}' AS variable, CAST(MAX(n) AS BIGINT) AS n,
       ROUND(SUM(CASE WHEN lw <= lobs + ln(1 + 1e-7) THEN p ELSE 0 END) / SUM(p), 6) AS p_value FROM s"""


@register("fisher_exact_rxc", sql=_rxc_sql("band", "grp", "abc", ["low", "top"], "mid"))
def q_fisher_rxc(spark, d):
    return rounded(fisher_rxc(A._cells(rare_balances(spark, d), ["band"], "grp")))


@register("fisher_exact_2x4", sql=_rxc_sql("rare", "segment", "wxyz", ["top"], "rest"))
def q_fisher_2x4(spark, d):
    return rounded(fisher_rxc(A._cells(rare_balances(spark, d), ["rare"], "segment")))


# Suppliers of two regions; at small scale factors both have fewer than 50, at larger ones the rule takes the
# normal approximation.  The oracle sums the law's characteristic function over the roots of unity of an order
# that is prime and larger than any product of two such sizes.
_TWO_REGIONS = "(SELECT s_acctbal, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey " \
               "JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))"


@register("rank_sum_exact", sql=f"""
WITH a AS ({_ranksum_full(_TWO_REGIONS + " sup", "s_acctbal", "r_name")}),
ties AS (SELECT COUNT(*) - COUNT(DISTINCT s_acctbal) AS t FROM {_TWO_REGIONS} sup),
s AS (SELECT variable, statistic, n1, n2, z, p_value, n1 < 50 AND n2 < 50 AND t = 0 AS small,
             LEAST(statistic, n1 * n2 - statistic) AS tail FROM a, ties),
f AS (SELECT t, EXP(SUM(LN(ABS(SIN(PI() * (hi + i) * t / 2411) / SIN(PI() * i * t / 2411) * i / (hi + i)))))
             * (CASE WHEN SUM(CASE WHEN SIN(PI() * (hi + i) * t / 2411) / SIN(PI() * i * t / 2411) < 0 THEN 1 ELSE 0 END) % 2 = 0
                     THEN 1 ELSE -1 END) AS g
      FROM (SELECT LEAST(n1, n2) AS lo, GREATEST(n1, n2) AS hi FROM s WHERE small) b,
           (SELECT unnest(range(1, 2411)) AS t) r, (SELECT unnest(range(1, 50)) AS i) e WHERE i <= lo GROUP BY t),
p AS (SELECT LEAST(1, 2 * SUM(1 + c) / 2411) AS exact_p FROM (
      SELECT k, SUM(g * COS(2 * PI() * t * (k - n1 * n2 / 2.0) / 2411)) AS c
      FROM s, f, (SELECT unnest(range(0, 2402)) AS k) ks WHERE k <= tail GROUP BY k) q)
SELECT variable, ROUND(statistic, 6) AS statistic, n1, n2, ROUND(z, 6) AS z,
       ROUND(CASE WHEN small THEN exact_p ELSE p_value END, 6) AS p_value,
       CASE WHEN small THEN 'exact' ELSE 'normal' END AS method FROM s, p""")
def q_rank_sum_exact(spark, d):
    j = (table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
         .join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).filter("r_name IN ('ASIA', 'EUROPE')"))
    return rounded(A.rank_sum_test(j.select("s_acctbal", "r_name"), ["s_acctbal"], "r_name", exact=True))


_OP = f"(SELECT *, {PERIOD_SQL} AS period FROM orders)"


@register("association_table", sql=f"""
WITH t AS (
  SELECT variable, 'chisq' AS test, statistic, p_value FROM ({_with_p(_chi2_sql(_OP, "o_orderstatus", "period"))}) a
  UNION ALL
  SELECT variable, 'chisq', statistic, p_value FROM ({_with_p(_chi2_sql(_OP, "o_orderpriority", "period"))}) b
  UNION ALL
  SELECT variable, 'rank_sum', statistic, p_value FROM ({_ranksum_full(_OP, "o_totalprice", "period")}) c)
SELECT variable, test, ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value,
       p_value < 0.05 AS significant FROM t""")
def q_association_table(spark, d):
    t = A.association_table(orders_period(spark, d), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"],
                            "period")
    return rounded(t)


@register("quantiles_linear", sql="""
SELECT variable, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(quantile_cont(value, 0.1), 6) AS p10, ROUND(quantile_cont(value, 0.5), 6) AS p50,
       ROUND(quantile_cont(value, 0.9), 6) AS p90
FROM (SELECT 'l_quantity' AS variable, CAST(l_quantity AS DOUBLE) AS value FROM lineitem
      UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem) u
WHERE value IS NOT NULL GROUP BY variable""")
def q_quantiles_linear(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(SM.exact_quantiles(li, ["l_quantity", "l_extendedprice"], (0.1, 0.5, 0.9), method="linear"))
