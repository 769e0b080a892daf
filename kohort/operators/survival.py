"""Kaplan-Meier, confidence limits, medians, risk tables, delayed entry and
log-rank tests (survey 2.11, K1-K9).

Every estimator starts from the collapsed table ``(group..., t, n_event,
n_obs)``: a partial aggregate that shrinks any number of subjects to at most
groups x distinct times rows.  Risk sets are suffix sums and survival is a
prefix product over time, computed with the two-level running aggregate of
:mod:`kohort.operators.prefix` (no single-partition window).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.functions.stats import Z975, chi2_sf
from kohort.operators.prefix import running_aggs, scaled_buckets
from kohort.session import materialize


def surv_data(df: DataFrame, time: str, event: str, by=()) -> DataFrame:
    """Right-censored data: rows with NULL time/event/group are removed;
    event must be 0/1."""
    cols = [F.col(b) for b in by] + [F.col(time).alias("t"), F.col(event).cast("bigint").alias("e")]
    out = df.select(*cols)
    for c in [*by, "t", "e"]:
        out = out.filter(F.col(c).isNotNull())
    return out


def collapse(df: DataFrame, time: str, event: str, by=()) -> DataFrame:
    """``(by..., t, n_event, n_obs)``; map-side combined."""
    s = surv_data(df, time, event, by)
    return s.groupBy(*by, "t").agg(F.sum("e").alias("n_event"), F.count(F.lit(1)).alias("n_obs"))


def _km_from_risk(c: DataFrame, by, n_buckets, bucket_col: str | None = None) -> DataFrame:
    """Given ``(by, t, n_risk, n_event, ...)`` add surv and Greenwood sum."""
    c = c.withColumns({
        "__f": F.when(F.col("n_risk") > 0, 1.0 - F.col("n_event") / F.col("n_risk")).otherwise(F.lit(1.0)),
        "__g": F.when(F.col("n_risk") > F.col("n_event"),
                      F.col("n_event") / (F.col("n_risk").cast("double") * (F.col("n_risk") - F.col("n_event"))))
                .otherwise(F.lit(0.0)),
    })
    out = running_aggs(c, list(by), "t", sums={"greenwood": "__g"}, products={"surv": "__f"},
                       n_buckets=n_buckets, bucket_col=bucket_col)
    return out.drop("__f", "__g")


def _add_conf(df: DataFrame, z: float) -> DataFrame:
    """Standard error of S and log-scale limits (upper capped at 1)."""
    s, g = F.col("surv"), F.col("greenwood")
    pos = s > 0
    return df.withColumns({
        "std_err": s * F.sqrt(g),
        "lower": F.when(pos, s * F.exp(-z * F.sqrt(g))),
        "upper": F.when(pos, F.least(F.lit(1.0), s * F.exp(z * F.sqrt(g)))),
    })


def kaplan_meier(df: DataFrame, time: str, event: str, by=(), conf_level: float = 0.95,
                 n_buckets: int = 1024) -> DataFrame:
    """Product-limit curve per group at every distinct time (event or
    censoring): ``by..., time, n_risk, n_event, n_censor, surv, std_err,
    lower, upper``."""
    by = list(by)
    # the collapsed table is small and feeds several branches: checkpoint it
    # so the input is read once whatever the optimizer prunes per branch
    c = materialize(collapse(df, time, event, by))
    c = scaled_buckets(c, by, "t", n_buckets, name="__kb")   # shared by both passes
    c = running_aggs(c, by, "t", suffix_sums={"n_risk": "n_obs"}, bucket_col="__kb")
    c = c.withColumn("n_censor", F.col("n_obs") - F.col("n_event"))
    km = _km_from_risk(c, by, n_buckets, bucket_col="__kb").drop("__kb")
    z = Z975 if conf_level == 0.95 else _zq(conf_level)
    km = _add_conf(km, z)
    return km.select(*by, F.col("t").alias("time"), F.col("n_risk").cast("bigint"),
                     F.col("n_event").cast("bigint"), F.col("n_censor").cast("bigint"),
                     "surv", "std_err", "lower", "upper", "greenwood")


def _zq(level: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def km_summary(km: DataFrame, by=(), tol: float = 1e-12) -> DataFrame:
    """Records, events, median survival and its confidence limits, all
    read from the curve table (records = at-risk count at the first time,
    events = sum of events), so the input is not scanned again.

    Median = first time with S <= 0.5; when S is exactly 0.5 on a step, the
    midpoint to the next drop.  Limits: first times where the lower / upper
    confidence curve reaches 0.5 (the lower curve gets there first).  NULL
    when never reached."""
    by = list(by)
    half = 0.5
    drop = F.col("n_event") > 0

    def first_time(cond):
        return F.min(F.when(drop & cond, F.col("time")))
    med = km.groupBy(*by).agg(
        F.max("n_risk").cast("bigint").alias("records"), F.sum("n_event").cast("bigint").alias("events"),
        first_time(F.col("surv") <= half + tol).alias("__m"),
        first_time(F.abs(F.col("surv") - half) <= tol).alias("__flat"),
        first_time(F.col("surv") < half - tol).alias("__after"),
        first_time(F.col("lower") <= half + tol).alias("lower_ci"),
        first_time(F.col("upper") <= half + tol).alias("upper_ci"))
    median = (F.when(F.col("__flat").isNotNull() & F.col("__after").isNotNull(),
                     (F.col("__flat") + F.col("__after")) / 2.0)
               .otherwise(F.col("__m").cast("double")))
    return med.filter("records IS NOT NULL").select(*by, "records", "events", median.alias("median"), F.col("lower_ci").cast("double"),
                      F.col("upper_ci").cast("double"))


def curve_points(km: DataFrame, by=(), ylim: tuple[float, float] | None = None) -> DataFrame:
    """Step points for plotting: the curve plus an origin row (t=0, S=1)
    per group, its at-risk count read from the curve; ``in_window`` marks
    points inside ``ylim``."""
    by = list(by)
    n = km.groupBy(*by).agg(F.max("n_risk").cast("bigint").alias("n_risk"))
    origin = n.select(*by, F.lit(0).cast(km.schema["time"].dataType).alias("time"), "n_risk",
                      F.lit(0).cast("bigint").alias("n_event"), F.lit(0).cast("bigint").alias("n_censor"),
                      F.lit(1.0).alias("surv"), F.lit(1.0).alias("lower"), F.lit(1.0).alias("upper"))
    pts = km.select(*by, "time", "n_risk", "n_event", "n_censor", "surv", "lower", "upper").unionByName(origin)
    lo, hi = ylim if ylim else (0.0, 1.0)
    tol = 1e-12  # products of step factors land within ulps of round limits
    return pts.withColumn("in_window", (F.col("surv") >= lo - tol) & (F.col("surv") <= hi + tol))


def risk_table(df: DataFrame, time: str, event: str, times, by=()) -> DataFrame:
    """Number at risk (time >= b) per group at each break ``b``: one
    conditional aggregate per break, then unpivoted; no join."""
    by = list(by)
    s = surv_data(df, time, event, by)
    wide = s.groupBy(*by).agg(*[F.sum(F.when(F.col("t") >= b, 1).otherwise(0)).alias(f"b{i}")
                                for i, b in enumerate(times)])
    kind = "BIGINT" if all(float(b).is_integer() for b in times) else "DOUBLE"
    stack = ", ".join(f"CAST({b} AS {kind}), CAST(b{i} AS BIGINT)" for i, b in enumerate(times))
    return wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(times)}, {stack}) AS (time, n_risk)")


def km_delayed_entry(df: DataFrame, start: str, stop: str, event: str, by=(),
                     n_buckets: int = 1024) -> DataFrame:
    """Product-limit curve with delayed entry: a subject is at risk on
    ``(start, stop]``.  Rows with ``stop <= start`` are dropped.

    At-risk(t) = #{start < t} - #{stop < t}: entries and exits are two
    aggregated event lists, unioned and prefix-summed once."""
    by = list(by)
    base = df.select(*by, F.col(start).alias("__s"), F.col(stop).alias("__x"),
                     F.col(event).cast("bigint").alias("__e"))
    for c in [*by, "__s", "__x", "__e"]:
        base = base.filter(F.col(c).isNotNull())
    base = base.filter(F.col("__x") > F.col("__s"))
    entries = base.groupBy(*by, F.col("__s").alias("t")).agg(F.count(F.lit(1)).alias("n_in")) \
        .withColumns({"n_out": F.lit(0).cast("bigint"), "n_event": F.lit(0).cast("bigint")})
    exits = base.groupBy(*by, F.col("__x").alias("t")).agg(
        F.count(F.lit(1)).alias("n_out"), F.sum("__e").alias("n_event")).withColumn("n_in", F.lit(0).cast("bigint"))
    ev = materialize(entries.unionByName(exits).groupBy(*by, "t").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("n_event").alias("n_event")))
    ev = scaled_buckets(ev, by, "t", n_buckets, name="__kb")   # shared by both passes
    ev = running_aggs(ev, by, "t", sums={"__cin": "n_in", "__cout": "n_out"}, bucket_col="__kb")
    ev = ev.withColumn("n_risk", (F.col("__cin") - F.col("n_in")) - (F.col("__cout") - F.col("n_out")))
    ev = ev.filter(F.col("n_out") > 0).withColumn("n_censor", F.col("n_out") - F.col("n_event"))
    km = _km_from_risk(ev.select(*by, "t", "n_risk", "n_event", "n_censor", "__kb"), by, n_buckets,
                       bucket_col="__kb").drop("__kb")
    return km.select(*by, F.col("t").alias("time"), F.col("n_risk").cast("bigint"),
                     F.col("n_event").cast("bigint"), F.col("n_censor").cast("bigint"), "surv")


def delayed_entry_excluded(df: DataFrame, start: str, stop: str) -> DataFrame:
    """How many complete rows the delayed-entry curve drops because exit
    does not follow entry (``stop <= start``): ``n_rows, n_excluded``."""
    ok = df.filter(F.col(start).isNotNull() & F.col(stop).isNotNull())
    return ok.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.count_if(F.col(stop) <= F.col(start)).cast("bigint").alias("n_excluded"))


# --- log-rank ------------------------------------------------------------------

def _worker_helpers():
    """Helpers used inside Python tasks, built as closures so they travel
    to the workers by value (no package import needed there)."""
    import numpy as _np

    def ratio(num, den):
        """num / den, NULL (NaN -> null in Arrow) where den is not positive."""
        out = _np.full(len(num), _np.nan)
        ok = den > 0
        out[ok] = num[ok] / den[ok]
        return out
    return ratio


CELLS_PER_BUCKET = 200_000   # (time, level) cells that one task sums
GRID = 1 << 21               # numbers of the time x level grid that a task holds at a time


def _logrank(c: DataFrame, level_type: str) -> DataFrame:
    """Log-rank results per ``variable`` and ``level`` from collapsed cells
    ``(variable, level, t, n_event, n_obs)``.

    Cells stay in long form, so the number of levels is not limited.  Times
    are split into range buckets of about equally many cells; a bucket
    starts from each level's at-risk count behind it (a suffix sum over the
    small bucket table), walks its own times in numpy blocks and yields its
    share of the expected events and of the covariance, which Spark sums.
    One (k-1) x (k-1) solve per variable is left."""
    buckets = max(1, -(-c.count() // CELLS_PER_BUCKET))
    totals = c.groupBy("variable", "level").agg(F.sum("n_obs").alias("n"), F.sum("n_event").alias("observed"))
    lv = materialize(totals.withColumn("i", F.row_number().over(Window.partitionBy("variable").orderBy("level")) - 1))
    cells = c.join(lv.select("variable", "level", "i"), ["variable", "level"]).drop("level")
    cells = materialize(scaled_buckets(cells, ["variable"], "t", buckets, name="tb"))

    held = cells.groupBy("variable", "tb", "i").agg(F.sum("n_obs").alias("m"))
    grid = cells.select("variable", "tb").distinct().join(lv.select("variable", "i"), "variable")
    later = Window.partitionBy("variable", "i").orderBy(F.desc("tb")).rowsBetween(Window.unboundedPreceding, -1)
    behind = (grid.join(held, ["variable", "tb", "i"], "left")
              .select("variable", "tb", "i", F.coalesce(F.sum("m").over(later), F.lit(0)).alias("after"))
              .toDF("variable", "tb", "i", "after"))   # columns of its own, apart from those of cells

    def share(cells, behind):
        k = len(behind)
        at_risk = np.zeros(k)
        at_risk[behind["i"].to_numpy()] = behind["after"].to_numpy()
        E, V = np.zeros(k), np.zeros((k, k))
        times, row = np.unique(cells["t"].to_numpy(), return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, level = row[order], cells["i"].to_numpy()[order]
        seen, died = cells["n_obs"].to_numpy(float)[order], cells["n_event"].to_numpy(float)[order]
        block = max(1, GRID // k)
        for stop in range(len(times), 0, -block):  # from the last time to the first
            start = max(0, stop - block)
            part = slice(*np.searchsorted(row, [start, stop]))
            risk = np.zeros((stop - start, k))
            np.add.at(risk, (row[part] - start, level[part]), seen[part])
            risk = at_risk + np.cumsum(risk[::-1], axis=0)[::-1]
            at_risk = risk[0]
            d = np.bincount(row[part] - start, weights=died[part], minlength=stop - start)
            event = d > 0
            d, n = d[event], risk[event].sum(axis=1)
            w = np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1), 0.0)
            p = risk[event] / n[:, None]
            E += d @ p
            V += np.diag(w @ p) - (p * w[:, None]).T @ p
        i, j = np.indices((k, k)).reshape(2, -1)
        return pd.DataFrame({"variable": cells["variable"].iloc[0], "i": np.concatenate([np.arange(k), i]),
                             "j": np.concatenate([np.full(k, -1), j]), "v": np.concatenate([E, V.ravel()])})

    keys = ["variable", "tb"]
    parts = (cells.groupBy(*keys).cogroup(behind.groupBy(*keys))
             .applyInPandas(share, "variable string, i int, j int, v double"))
    summed = parts.groupBy("variable", "i", "j").agg(F.sum("v").alias("v"))
    ratio, sf = _worker_helpers(), chi2_sf   # closures: shipped by value

    def solve(levels, sums):
        levels = levels.sort_values("i")
        k = len(levels)
        E, V = np.zeros(k), np.zeros((k, k))
        mean = sums["j"].to_numpy() < 0
        E[sums["i"][mean]] = sums["v"][mean]
        V[sums["i"][~mean], sums["j"][~mean]] = sums["v"][~mean]
        O = levels["observed"].to_numpy(float)
        diff, sub = (O - E)[: k - 1], V[: k - 1, : k - 1]
        stat, dfree = float("nan"), 0
        if k > 1:
            try:
                stat = float(diff @ np.linalg.solve(sub, diff))
            except np.linalg.LinAlgError:
                stat = float(diff @ np.linalg.pinv(sub) @ diff)
            dfree = int(np.linalg.matrix_rank(sub))
        p = sf(stat, dfree) if dfree > 0 else float("nan")
        return pd.DataFrame({"variable": levels["variable"], "level": levels["level"], "n": levels["n"].astype("int64"),
                             "observed": O, "expected": E, "oe2_e": ratio((O - E) ** 2, E),
                             "oe2_v": ratio((O - E) ** 2, np.diag(V)), "chisq": stat, "df": dfree, "p_value": p})
    schema = (f"variable string, level {level_type}, n bigint, observed double, expected double, oe2_e double, "
              f"oe2_v double, chisq double, df bigint, p_value double")
    return lv.groupBy("variable").cogroup(summed.groupBy("variable")).applyInPandas(solve, schema)


def logrank_test(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Per level: n, observed, expected, (O-E)^2/E, (O-E)^2/V, and the
    test chi-square on k-1 df with its p-value."""
    c = materialize(collapse(df, time, event, [by]).select(
        F.lit("by").alias("variable"), F.col(by).alias("level"), "t", "n_event", "n_obs"))
    out = _logrank(c, df.schema[by].dataType.simpleString())
    return out.drop("variable").withColumnRenamed("level", by)


def logrank_many(df: DataFrame, time: str, event: str, groupings: list[str]) -> DataFrame:
    """Log-rank tests for several grouping columns in one job: they are
    unpivoted to ``(variable, level)`` and the input is read once."""
    from kohort.operators.summary import unpivot  # local: summary imports prefix only
    long = unpivot(df.select(time, event, *groupings), groupings, keep=[time, event],
                   variable="variable", value="level")
    for c in (time, event, "level"):
        long = long.filter(F.col(c).isNotNull())
    c = materialize(long.groupBy("variable", "level", F.col(time).alias("t")).agg(
        F.sum(F.col(event).cast("bigint")).alias("n_event"), F.count(F.lit(1)).alias("n_obs")))
    return _logrank(c, "string")
