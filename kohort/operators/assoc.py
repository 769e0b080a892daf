"""Group association tests (survey 2.10, J7-J11).

Each test is batched over many variables: counts (or ranks) for all
variables come from one unpivoted aggregate, statistics are column
arithmetic on the small per-variable tables, and tail probabilities are
JVM expressions (incomplete gamma via higher-order functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.functions.stats import chi2_sf_sql, lgamma_sql, norm_sf2_sql
from kohort.operators.exact import EXACT_BELOW, MAX_ARCS, fisher_rxc, rank_sum_exact_sql
from kohort.operators.prefix import running_aggs, scaled_buckets
from kohort.operators.summary import unpivot
from kohort.session import materialize

STEPS_PER_ROW = 10_000  # values of an exact test's support that one row stands for before the last explode


def _cells(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Cell counts ``(variable, level, grp, o)``, checkpointed: margins,
    totals and the statistic all read this small table, not the input."""
    long = unpivot(df, cols, keep=[by]).filter(F.col("value").isNotNull() & F.col(by).isNotNull())
    return materialize(long.groupBy("variable", F.col("value").alias("level"), F.col(by).cast("string").alias("grp"))
                       .agg(F.count(F.lit(1)).alias("o")))


def chi2_test(df: DataFrame, cols: list[str], by: str, cells: DataFrame | None = None) -> DataFrame:
    """Pearson chi-square without continuity correction per variable:
    ``variable, statistic, df, p_value, min_expected, n``.

    Empty cells are not materialised: their contribution (0-E)^2/E = E sums
    to N - (sum of E over the observed cells).  ``cells`` may be passed in
    when several tests share one count table."""
    cells = cells if cells is not None else _cells(df, cols, by)
    rt = cells.groupBy("variable", "level").agg(F.sum("o").alias("r"))
    ct = cells.groupBy("variable", "grp").agg(F.sum("o").alias("c"))
    tot = rt.groupBy("variable").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("nr"),
                                     F.min("r").alias("rmin"))
    ctot = ct.groupBy("variable").agg(F.count(F.lit(1)).alias("nc"), F.min("c").alias("cmin"))
    j = cells.join(rt, ["variable", "level"]).join(ct, ["variable", "grp"]).join(tot, "variable")
    e = F.col("r").cast("double") * F.col("c") / F.col("n")
    per = j.groupBy("variable").agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("__obs"), F.sum(e).alias("__esum"),
        F.first("n").alias("n"), F.first("nr").alias("nr"), F.first("rmin").alias("rmin"))
    per = per.join(ctot, "variable")
    stat = F.col("__obs") + (F.col("n") - F.col("__esum"))
    dfree = ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("bigint")
    out = per.select("variable", stat.alias("statistic"), dfree.alias("df"),
                     (F.col("rmin").cast("double") * F.col("cmin") / F.col("n")).alias("min_expected"),
                     F.col("n").cast("bigint"), F.col("nr"), F.col("nc"))
    return out.withColumn("p_value", F.expr(chi2_sf_sql("statistic", "df")))


def fisher_2x2(df: DataFrame, cols: list[str], by: str, cells: DataFrame | None = None) -> DataFrame:
    """Two-sided Fisher exact test for 2x2 tables: ``variable, a, b, c, d,
    p_value`` (cells in level x group order; p sums the hypergeometric
    probabilities not above the observed one, relative tolerance 1e-7).

    The support of cell a is exploded to one row per value and summed by
    an aggregate: JVM-side, and dealt out in runs of ``STEPS_PER_ROW``
    values, so that a large margin is spread over tasks."""
    cells = cells if cells is not None else _cells(df, cols, by)
    # 2x2 only: two levels and two groups per variable, found with counts
    # and min/max (no per-variable level lists)
    shape = cells.groupBy("variable").agg(
        F.count_distinct("level").alias("nl"), F.count_distinct("grp").alias("ng"),
        F.min("level").alias("l0"), F.min("grp").alias("g0"))
    shape = shape.filter((F.col("nl") == 2) & (F.col("ng") == 2))
    j = cells.join(shape, "variable")
    i0 = F.col("level") == F.col("l0")
    g0 = F.col("grp") == F.col("g0")
    wide = j.groupBy("variable").agg(
        F.sum(F.when(i0 & g0, F.col("o")).otherwise(0)).alias("a"),
        F.sum(F.when(i0 & ~g0, F.col("o")).otherwise(0)).alias("b"),
        F.sum(F.when(~i0 & g0, F.col("o")).otherwise(0)).alias("c"),
        F.sum(F.when(~i0 & ~g0, F.col("o")).otherwise(0)).alias("d"))

    # hypergeometric support of cell a, one row per value
    wide = wide.selectExpr("*", "a + b AS r1", "a + c AS c1", "a + b + c + d AS n")
    lg = lambda z: lgamma_sql(f"CAST({z} AS DOUBLE) + 1D")   # log(z!)
    # log P(x) = K - log x! - log (r1-x)! - log (c1-x)! - log (n-r1-c1+x)!, K per variable
    wide = wide.selectExpr("*", f"({lg('r1')} + {lg('n - r1')} + {lg('c1')} + {lg('n - c1')} - {lg('n')}) AS k0")
    lp = lambda x: f"(k0 - {lg(x)} - {lg(f'r1 - {x}')} - {lg(f'c1 - {x}')} - {lg(f'n - r1 - c1 + {x}')})"
    wide = wide.selectExpr("*", f"{lp('a')} AS lobs")
    sup = wide.selectExpr("*", "least(r1, c1) AS hi")
    sup = sup.selectExpr("*", f"explode(sequence(greatest(0L, r1 + c1 - n), hi, {STEPS_PER_ROW}L)) AS x0") \
        .repartition("variable", "x0")
    sup = sup.selectExpr("*", f"explode(sequence(x0, least(x0 + {STEPS_PER_ROW - 1}L, hi))) AS x")
    sup = sup.selectExpr("variable", "a", "b", "c", "d", "lobs", f"{lp('x')} AS lp")
    out = sup.groupBy("variable", "a", "b", "c", "d").agg(
        F.expr("least(1D, SUM(CASE WHEN lp <= lobs + ln(1D + 1e-7D) THEN exp(lp) ELSE 0D END))").alias("p_value"))
    return out.select("variable", *[F.col(x).cast("bigint") for x in "abcd"], "p_value")


def rank_sum_test(df: DataFrame, cols: list[str], by: str, n_buckets: int = 1024,
                  exact: bool = False) -> DataFrame:
    """Wilcoxon rank-sum (Mann-Whitney) for a two-level group, per
    variable: W of the first group (level order), normal approximation
    with tie-corrected variance and continuity correction.

    With ``exact``, variables without ties and with fewer than 50 values in
    either group get the exact law's p-value, and a column ``method`` tells
    which (``exact`` or ``normal``; NULL without two groups).

    Values are collapsed to ``(variable, value)`` counts and mid-ranks come
    from a distributed prefix sum over the distinct values."""
    long = unpivot(df, cols, keep=[by], as_string=False) \
        .filter(F.col("value").isNotNull() & F.col(by).isNotNull())
    # one pass over the input: counts per (variable, value, group), checkpointed
    vg = materialize(long.groupBy("variable", "value", F.col(by).cast("string").alias("__g"))
                     .agg(F.count(F.lit(1)).alias("c")))
    first = vg.groupBy("variable").agg(F.min("__g").alias("__g1"), F.count_distinct("__g").alias("__ng"))
    # the test is defined for exactly two groups; other variables get NULLs.  A row a variable is broadcast: a
    # shuffle by variable would put all of its values into one task
    counts = vg.join(F.broadcast(first.filter(F.col("__ng") == 2)), "variable").groupBy("variable", "value").agg(
        F.sum("c").alias("t"), F.sum(F.when(F.col("__g") == F.col("__g1"), F.col("c")).otherwise(0)).alias("t1"))
    counts = scaled_buckets(counts, ["variable"], "value", n_buckets)
    counts = running_aggs(counts, ["variable"], "value", sums={"cum": "t"}, bucket_col="__qb")
    rank = F.col("cum") - F.col("t") + (F.col("t") + 1) / 2.0
    per = counts.groupBy("variable").agg(
        F.sum(F.col("t1") * rank).alias("r1"), F.sum("t1").alias("n1"),
        (F.sum("t") - F.sum("t1")).alias("n2"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    w = F.col("r1") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.when(n1 + n2 > 1,
                   F.sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - F.col("ties") / ((n1 + n2) * (n1 + n2 - 1)))))
    z = F.when(sigma > 0, (w - mu - F.signum(w - mu) * 0.5) / sigma)   # NULL when undefined
    out = per.select("variable", w.alias("statistic"), F.col("n1").cast("bigint"),
                     F.col("n2").cast("bigint"), z.alias("z"), (F.col("ties") > 0).alias("__tied"))
    # variables without exactly two groups appear with NULL statistics
    others = first.filter(F.col("__ng") != 2).select(
        "variable", F.lit(None).cast("double").alias("statistic"), F.lit(None).cast("bigint").alias("n1"),
        F.lit(None).cast("bigint").alias("n2"), F.lit(None).cast("double").alias("z"),
        F.lit(None).cast("boolean").alias("__tied"))
    out = out.unionByName(others)
    if not exact:
        return out.drop("__tied").withColumn("p_value", F.expr(norm_sf2_sql("z")))
    small = ~F.col("__tied") & (F.col("n1") < EXACT_BELOW) & (F.col("n2") < EXACT_BELOW)
    p = F.when(small, F.expr(rank_sum_exact_sql("statistic", "n1", "n2"))).otherwise(F.expr(norm_sf2_sql("z")))
    method = F.when(small, "exact").when(F.col("__tied").isNotNull(), "normal")
    return out.withColumns({"p_value": p, "method": method}).drop("__tied")


def flag_significant(df: DataFrame, alpha: float = 0.05, p: str = "p_value") -> DataFrame:
    return df.withColumn("significant", F.col(p) < alpha)


def association_table(df: DataFrame, categorical: list[str], continuous: list[str], by: str,
                      alpha: float = 0.05) -> DataFrame:
    """One row per variable: the test chosen per type and expected count,
    with statistic, p-value and significance.

    Categorical: chi-square when every expected count is 5 or more, else
    the exact test (2x2 or larger); where an exact test of a larger table
    is out of reach (``max_arcs`` of :func:`fisher_rxc`), chi-square flagged
    ``chisq_low_expected``.  Continuous: rank-sum, with the exact law for
    untied samples below 50 (``rank_sum_exact``)."""
    parts = []
    if categorical:
        cells = _cells(df, categorical, by)   # one count table for all tests
        chi = materialize(chi2_test(df, categorical, by, cells))
        # the exact tests only where the expected counts call for them
        few = cells.join(chi.filter("min_expected < 5").select("variable"), "variable", "left_semi")
        two = chi.filter("nr = 2 AND nc = 2").select("variable")
        fis = fisher_2x2(df, categorical, by, few).select("variable", F.col("p_value").alias("__fp"))
        big = fisher_rxc(few.join(two, "variable", "left_anti"), MAX_ARCS).select("variable", F.col("p_value").alias("__fp"))
        j = chi.join(fis.unionByName(big), "variable", "left")
        small = F.col("min_expected") < 5
        use_f = small & F.col("__fp").isNotNull()
        parts.append(j.select(
            "variable",
            F.when(use_f, "fisher").when(small, "chisq_low_expected").otherwise("chisq").alias("test"),
            F.when(use_f, F.lit(None).cast("double")).otherwise(F.col("statistic")).alias("statistic"),
            F.when(use_f, F.col("__fp")).otherwise(F.col("p_value")).alias("p_value")))
    if continuous:
        rs = rank_sum_test(df, continuous, by, exact=True)
        parts.append(rs.select("variable", F.when(F.col("method") == "exact", "rank_sum_exact").otherwise("rank_sum").alias("test"),
                               "statistic", "p_value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return flag_significant(out, alpha)
