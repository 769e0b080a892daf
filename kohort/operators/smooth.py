"""Smoothed curves through residuals (K17, K18): local linear regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_points(df: DataFrame, x: str, n: int = 21) -> DataFrame:
    """``n`` evenly spaced points over the range of ``x``: one column ``point``; none for an empty table."""
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).filter(F.col("lo").isNotNull())
    place = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return place.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(max(n - 1, 1))).alias("point"))


def local_linear(df: DataFrame, x: str, y: str, points: DataFrame, bandwidth: float, by: list[str] | None = None) -> DataFrame:
    """(by, point, fit): at each ``point`` of ``points``, the weighted least-squares line through the rows whose ``x``
    is nearer than ``bandwidth``, with tricube weights, read at the point.

    Rows lie in ranges of one bandwidth; a point goes to its own range and to
    the two beside it, so that points and rows meet by an equality join and a
    range holds all that its points need.  Rows of one ``x`` are summed before.
    The line's sums combine map-side.  Where all rows near a point share one
    ``x`` the fit is their mean; a point without rows near it has no row, and
    rows with a NULL or NaN in ``x`` or ``y`` take no part.
    """
    if not bandwidth > 0:
        raise ValueError("bandwidth must be positive")
    by = by or []
    keys = [F.col(c) for c in by]
    width = F.lit(float(bandwidth))
    at, value = F.col(x).cast("double"), F.col(y).cast("double")
    rows = (df.filter(at.isNotNull() & value.isNotNull() & ~F.isnan(at) & ~F.isnan(value))
            .groupBy(*keys, at.alias("__x")).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__y"))
            .withColumn("__range", F.floor(F.col("__x") / width)))
    near = points.select("point").distinct().withColumn(
        "__range", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                         lambda k: F.floor(F.col("point") / width) + k)))
    u = (F.col("__x") - F.col("point")) / width
    met = rows.join(near, "__range").withColumn("__u", u).filter(F.abs("__u") < 1)
    w = F.pow(1 - F.pow(F.abs("__u"), F.lit(3)), F.lit(3))
    met = met.withColumn("__w", w)
    n, s = F.col("__w") * F.col("__n"), F.col("__w") * F.col("__y")
    sums = met.groupBy(*by, "point").agg(
        F.sum(n).alias("s0"), F.sum(n * F.col("__u")).alias("s1"), F.sum(n * F.col("__u") * F.col("__u")).alias("s2"),
        F.sum(s).alias("t0"), F.sum(s * F.col("__u")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    return sums.select(*by, "point", F.when(det > 1e-12 * F.col("s0") * F.col("s2"), line)
                       .otherwise(F.col("t0") / F.col("s0")).alias("fit"))
