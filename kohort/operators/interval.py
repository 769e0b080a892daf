"""Survival from interval-censored times (survey K2, read literally).

An event is known to lie in ``(left, right]``; ``left = right`` is an exact time,
a NULL right end a censored one (not seen yet at ``left``), a NULL left end an
event before or at ``right``.  The nonparametric estimate puts mass only on the
innermost intervals: those from a left end to the next right end with no other
end between.

* One pass over the input collapses it to distinct intervals with their counts.
* The sweep over the sorted distinct ends is a numbering by range buckets and a
  join of each end with the next; running counts turn every interval into the
  first and last innermost interval that it holds.
* A self-consistency step needs, for every interval, the mass that it holds (a
  difference of two running sums of the masses, which are broadcast) and, for every
  innermost interval, the sum of n / mass over the intervals that hold it: the
  running sum of what begins and stops there, an aggregate with at most two rows
  for each innermost interval.  The distinct intervals stay in the shared folder.

The masses are the model, one number for each innermost interval.  There are at
most as many as distinct times; more than MAX_PLACES are refused.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.operators.prefix import running_aggs
from kohort.session import materialize

BEFORE, NEVER = -(1 << 62), 1 << 62   # ends of intervals that are open to either side
MAX_PLACES = 1 << 20   # innermost intervals: 8 MB of masses on the driver and in a broadcast


def _ends(df: DataFrame, left: str, right: str) -> DataFrame:
    """``(lo, hi, n)``: distinct closed intervals on an axis where time t is 2t and the moment behind it 2t + 1."""
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    lo = F.when(a.isNull(), BEFORE).when(a == b, 2 * a).otherwise(2 * a + 1)
    hi = F.when(b.isNull(), NEVER).otherwise(2 * b)
    rows = df.filter((a.isNotNull() | b.isNotNull()) & (a.isNull() | b.isNull() | (a <= b)))
    return rows.select(lo.alias("lo"), hi.alias("hi")).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def _innermost(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(j, lo, hi)`` of the innermost intervals from 1, and ``(a, b, n)``: the first and last one that an interval holds."""
    ends = seen.select(F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(c == "lo").alias("l"), F.lit(c == "hi").alias("r"))
                                           for c in ("lo", "hi")])).alias("e")).select("e.*")
    ends = materialize(ends.groupBy("at").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"), F.lit(1).alias("one")))
    ends = materialize(running_aggs(ends, [], "at", sums={"i": "one"}))
    ahead = ends.select((F.col("i") - 1).alias("i"), F.col("at").alias("then"), F.col("l").alias("then_l"))
    found = ends.join(ahead, "i", "left").filter(F.col("l") & (F.col("r") | ~F.col("then_l"))).select(
        F.col("at").alias("lo"), F.when(F.col("r"), F.col("at")).otherwise(F.col("then")).alias("hi"))
    found = materialize(found)
    marks = (ends.select("at", "i").join(found.select(F.col("lo").alias("at"), F.lit(1).alias("begins")), "at", "left")
             .join(found.select(F.col("hi").alias("at"), F.lit(1).alias("stops")), "at", "left").fillna(0))
    marks = materialize(running_aggs(marks, [], "at", sums={"began": "begins", "over": "stops"}))
    places = found.join(marks.select(F.col("at").alias("lo"), F.col("began").alias("j")), "lo").select("j", "lo", "hi")
    held = (seen.join(marks.select(F.col("at").alias("lo"), (F.col("began") - F.col("begins") + 1).alias("a")), "lo")
            .join(marks.select(F.col("at").alias("hi"), F.col("over").alias("b")), "hi"))
    return materialize(places), materialize(held.groupBy("a", "b").agg(F.sum("n").alias("n")))


def _shares(upto):
    """Task code of a step, as a closure that travels by value: with the running sum of the masses (a broadcast),
    what begins (w) at a place and stops behind one, summed over the task's rows."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        cum = upto.value
        change = {}
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            w = n / (cum[b] - cum[a - 1])
            at, where = np.unique(np.concatenate([a, b + 1]), return_inverse=True)
            for j, v in zip(at.tolist(), np.bincount(where, weights=np.concatenate([w, -w])).tolist()):
                change[j] = change.get(j, 0.0) + v
        yield pa.RecordBatch.from_pydict({"j": pa.array(list(change), pa.int64()), "w": pa.array(list(change.values()), pa.float64())})
    return run


def _step(held: DataFrame, alone: np.ndarray, p: np.ndarray, total: int) -> np.ndarray:
    """The masses after one step; an interval around one place gives it its whole count (``alone``), whatever the mass."""
    upto = held.sparkSession.sparkContext.broadcast(np.concatenate([[0.0], np.cumsum(p)]))
    parts = held.mapInArrow(_shares(upto), "j bigint, w double").groupBy("j").agg(F.sum("w").alias("w"))
    change = np.zeros(len(p) + 2)
    for r in parts.collect():  # two rows a place at most
        change[r.j] = r.w
    upto.destroy()
    return (p * np.maximum(np.cumsum(change)[1:-1], 0.0) + alone) / total


def km_interval(df: DataFrame, left: str, right: str, max_iter: int = 1000, tol: float = 1e-8) -> DataFrame:
    """Self-consistent survival curve of interval-censored whole-number times (days):
    ``time_left, time_right, exact, mass, surv``, a row for each innermost interval.

    ``mass`` lies in ``(time_left, time_right]``, or at ``time_right`` where ``exact``; ``time_left`` is NULL for
    an interval without a beginning and ``time_right`` for one without an end; ``surv`` is the share beyond the
    interval.  Starts from equal masses; stops when no mass moves by more than ``tol``, or warns after
    ``max_iter`` steps.  Rows with two NULL ends, or with the right end before the left one, are left out;
    no rows give no rows.
    """
    spark = df.sparkSession
    seen = materialize(_ends(df, left, right))
    total = seen.agg(F.sum("n")).first()[0]
    places, held = _innermost(seen)
    m = places.count()
    if m > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} innermost intervals")
    alone = np.zeros(m)
    for r in held.filter("a = b").select("a", "n").collect():  # a row a place at most
        alone[r.a - 1] = r.n
    several = held.filter("a < b")
    p = np.full(m, 1.0 / max(m, 1))
    done = m <= 1 or max_iter == 0
    for _ in range(max_iter if m > 1 else 0):
        new = _step(several, alone, p, total)
        done = np.abs(new - p).max() <= tol
        p = new
        if done:
            break
    if not done and tol > 0:
        warnings.warn(f"the masses still moved after {max_iter} steps", stacklevel=2)
    rows = [(j + 1, float(x), float(s)) for j, (x, s) in enumerate(zip(p, np.maximum(0.0, 1.0 - np.cumsum(p))))]
    out = spark.createDataFrame(rows, "j bigint, mass double, surv double").join(places, "j")
    half = lambda c: F.shiftright(F.col(c), 1)
    return out.select(F.when(F.col("lo") > BEFORE, half("lo")).alias("time_left"), F.when(F.col("hi") < NEVER, half("hi")).alias("time_right"),
                      ((F.col("lo") % 2 == 0) & (F.col("lo") > BEFORE)).alias("exact"), "mass", "surv")
