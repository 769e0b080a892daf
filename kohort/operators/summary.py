"""Missingness and summary tables (survey 2.10, J1-J6).

Many variables are summarised in one job: columns are unpivoted to
``(variable, value)`` and aggregated together, so the table is scanned
once whatever the number of variables; partial aggregation shrinks the
unpivoted rows map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.functions.nulls import qcol
from kohort.operators.joins import join_null_safe
from kohort.operators.prefix import scaled_buckets
from kohort.session import materialize
from kohort.sources.io import sql_string

# Missing-ratio grades (upper bounds, right-closed).
NA_GRADES = [("Good", 0.05), ("OK", 0.1), ("NotBad", 0.2), ("Bad", 0.5), ("Remove", 1.0)]


def unpivot(df: DataFrame, cols: list[str], keep=(), as_string: bool = True,
            variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide -> long ``(keep..., variable, value)``."""
    vals = [qcol(c).cast("string") if as_string else qcol(c).cast("double") for c in cols]
    tmp = df.select(*[F.col(k) for k in keep], *[v.alias(f"__u{i}") for i, v in enumerate(vals)])
    return tmp.unpivot(list(keep), [f"__u{i}" for i in range(len(cols))], variable, value) \
        .withColumn(variable, F.element_at(F.create_map(*[x for i, c in enumerate(cols)
                                                          for x in (F.lit(f"__u{i}"), F.lit(c))]),
                                           F.col(variable)))


def na_pareto(df: DataFrame, only_na: bool = True) -> DataFrame:
    """Per column: missing count, ratio, cumulative % of all missing cells
    (columns sorted by count desc), grade.  One aggregate pass; the result
    has one row per column, so the cumulative window runs on a table whose
    size is the schema width."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(qcol(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"{sql_string(c)}, __m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("__n", f"stack({len(cols)}, {stack}) AS (variable, n_missing)")
    if only_na:
        long = long.filter(F.col("n_missing") > 0)
    ratio = F.when(F.col("__n") > 0, F.col("n_missing") / F.col("__n"))
    grade = None
    for name, hi in NA_GRADES:
        grade = F.when(ratio <= hi, name) if grade is None else grade.when(ratio <= hi, name)
    w = Window.orderBy(F.col("n_missing").desc(), F.col("variable")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return long.select(
        "variable", F.col("n_missing").cast("bigint"), ratio.alias("ratio"),
        F.when(F.sum("n_missing").over(Window.partitionBy()) > 0,
               F.sum("n_missing").over(w) * 100.0 / F.sum("n_missing").over(Window.partitionBy()))
         .alias("cumulative"),
        grade.alias("grade"))


def summary_categorical(df: DataFrame, cols: list[str], missing: bool = False) -> DataFrame:
    """``variable, level, n, pct`` with % over non-missing values; with
    ``missing`` a NULL level row (pct NULL) is kept."""
    long = unpivot(df, cols)
    if not missing:
        long = long.filter(F.col("value").isNotNull())
    counts = materialize(long.groupBy("variable", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n")))
    tot = counts.filter(F.col("level").isNotNull()).groupBy("variable").agg(F.sum("n").alias("__t"))
    out = counts.join(tot, "variable", "left")
    return out.select("variable", "level", F.col("n").cast("bigint"),
                      F.when(F.col("level").isNotNull(), F.col("n") * 100.0 / F.col("__t")).alias("pct"))


def exact_quantiles(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75), by=(),
                    names=None, n_buckets: int = 1024, method: str = "type2") -> DataFrame:
    """Exact sample quantiles as a distributed selection.

    1. values are collapsed to ``(by, variable, value, count)``
       (checkpointed: every later step reads this table),
    2. a histogram over equal-width value buckets gives each bucket's row
       offset (a prefix over at most ``n_buckets`` rows per variable),
    3. only the buckets holding a requested rank are ranked exactly, by a
       window partitioned by bucket; the values at the ranks are picked by
       conditional aggregates.

    No group is ever held in one task, and the exact ranking touches a few
    buckets instead of every distinct value.  ``method="type2"``: inverse
    empirical CDF with averaging at jumps (at p = 0.5 the ordinary median);
    ``method="linear"``: interpolation between order statistics at
    (n-1)p (type 7, as ``percentile`` / ``quantile_cont``).
    """
    if method not in ("type2", "linear"):
        raise ValueError(method)
    by = list(by)
    keys = [*by, "variable"]
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    long = unpivot(df, cols, keep=by, as_string=False).filter(F.col("value").isNotNull())
    counts = materialize(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt")))
    counts = scaled_buckets(counts, keys, "value", n_buckets, name="__qb")

    hist = counts.groupBy(*keys, "__qb").agg(F.sum("cnt").alias("__bt"))
    wb = Window.partitionBy(*keys).orderBy("__qb")
    hist = hist.withColumns({
        "__off": F.coalesce(F.sum("__bt").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("__bt").over(Window.partitionBy(*keys)),
    })

    def holds(pos):
        return (F.col("__off") <= pos) & (pos < F.col("__off") + F.col("__bt"))
    def positions(p):
        """0-based order statistics the quantile reads: (a, b, weight of b)."""
        if method == "linear":
            h = (F.col("n") - 1) * F.lit(float(p))
            return F.floor(h), F.ceil(h), h - F.floor(h)
        np_ = F.col("n") * F.lit(float(p))
        jj = F.floor(np_)
        # frac > 0: x[jj]; else the mean of x[jj-1] and x[jj]
        return jj, jj - 1, F.when(np_ - jj > 0, F.lit(0.0)).otherwise(F.lit(0.5))
    need = F.lit(False)
    for p in probs:
        a, b, _ = positions(p)
        need = need | holds(a) | holds(b)
    hist = hist.filter(need).select(*keys, "__qb", "__off", "n")

    cand = join_null_safe(counts, hist, [*keys, "__qb"], "inner")
    wi = Window.partitionBy(*keys, "__qb").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("cum", F.col("__off") + F.sum("cnt").over(wi))
    lo = F.col("cum") - F.col("cnt")          # 0-based position of the first copy
    hi = F.col("cum")                          # one past the last copy
    aggs = [F.first("n").alias("n")]
    for p, name in zip(probs, names):
        a, b, wgt = positions(p)
        aggs.append(F.max(F.when((lo <= a) & (a < hi), F.col("value"))).alias(f"__a_{name}"))
        aggs.append(F.max(F.when((lo <= b) & (b < hi), F.col("value"))).alias(f"__b_{name}"))
        aggs.append(F.first(wgt).alias(f"__w_{name}"))
    g = cand.groupBy(*keys).agg(*aggs)
    sel = [*keys, F.col("n").cast("bigint")]
    for name in names:
        va, vb, w = F.col(f"__a_{name}"), F.col(f"__b_{name}"), F.col(f"__w_{name}")
        # weight 0 reads x[a] alone (x[b] may not exist, e.g. b = -1)
        sel.append(F.when(w == 0, va).otherwise(va + w * (vb - va)).alias(name))
    return g.select(*sel)


def summary_continuous(df: DataFrame, cols: list[str], by=()) -> DataFrame:
    """``[by,] variable, n, median, q1, q3``."""
    q = exact_quantiles(df, cols, (0.5, 0.25, 0.75), by=by, names=["median", "q1", "q3"])
    return q


def crosstab(df: DataFrame, cols: list[str], by: str, percent: str = "row") -> DataFrame:
    """``variable, level, <by>, n, pct``; ``percent='row'`` divides by the
    level total, ``'col'`` by the group total (non-missing only)."""
    long = unpivot(df, cols, keep=[by]).filter(F.col("value").isNotNull() & F.col(by).isNotNull())
    counts = materialize(long.groupBy("variable", F.col("value").alias("level"), by)
                         .agg(F.count(F.lit(1)).alias("n")))
    part = ["variable", "level"] if percent == "row" else ["variable", by]
    tot = counts.groupBy(*part).agg(F.sum("n").alias("__t"))
    return counts.join(tot, part).select("variable", "level", by, F.col("n").cast("bigint"),
                                         (F.col("n") * 100.0 / F.col("__t")).alias("pct"))
