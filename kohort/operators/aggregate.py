"""Grouping, de-duplication and reshaping to one row per subject
(survey sections 2.5-2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.functions.nulls import strict_max, strict_min
from kohort.operators.ordering import order_struct, window_order


def session_summary(df: DataFrame, key: str, date_col: str, age_col: str,
                    lo=None, hi=None, prefix: str = "") -> DataFrame:
    """Per subject: youngest age, first and last session date, number of
    distinct sessions inside ``[lo, hi]`` (NULL ages ignored).

    ``distinct`` then filter: Catalyst pushes the date filter below the
    distinct and into the Parquet scan; the aggregate is map-side combined.
    """
    d = df.select(key, age_col, date_col).distinct()
    if lo is not None:
        d = d.filter(F.col(date_col) >= F.lit(lo).cast("date"))
    if hi is not None:
        d = d.filter(F.col(date_col) <= F.lit(hi).cast("date"))
    return d.groupBy(key).agg(
        F.min(age_col).alias(f"{prefix}age_first"),
        F.min(date_col).alias(f"{prefix}date_first"),
        F.max(date_col).alias(f"{prefix}date_last"),
        F.count(F.lit(1)).alias(f"{prefix}n_sessions"),
    )


def session_summary_strict(df: DataFrame, key: str, date_col: str, age_col: str,
                           lo=None, hi=None, prefix: str = "") -> DataFrame:
    """As :func:`session_summary`, but the minimum age is NULL when any
    session's age is NULL (``na.rm`` off, rule N11); first/last follow
    date order, which equals min/max because NULL dates fail the filter."""
    d = df.select(key, age_col, date_col).distinct()
    if lo is not None:
        d = d.filter(F.col(date_col) >= F.lit(lo).cast("date"))
    if hi is not None:
        d = d.filter(F.col(date_col) <= F.lit(hi).cast("date"))
    return d.groupBy(key).agg(
        strict_min(age_col).alias(f"{prefix}age_first"),
        F.min(date_col).alias(f"{prefix}date_first"),
        F.max(date_col).alias(f"{prefix}date_last"),
        F.count(F.lit(1)).alias(f"{prefix}n_sessions"),
    )


def collapse_multi(df: DataFrame, keys: list[str], first_last: list[str], order_by,
                   first_only: list[str] = (), strict_max_cols: list[str] = (),
                   mean_cols: list[str] = (), n_col: str = "n_records") -> DataFrame:
    """Several records per subject -> one wide row.

    ``x_1`` = value on the first record, ``x_2`` = value on the last record
    when the subject has more than one (else NULL); ``first_only`` columns
    keep the first value; ``strict_max_cols`` are NULL if any record is
    NULL; ``mean_cols`` average ignoring NULL.  All parts are ``min_by`` /
    ``max_by`` / ``count`` aggregates: one shuffle, partially aggregated.
    First and last record are picked whole, so that columns of records
    with tied order keys never mix.
    """
    ordkey = order_struct(df, order_by)
    if ordkey is None:
        raise ValueError("collapse_multi needs an order without descending nested keys")
    df = df.withColumn("__ord", ordkey)
    from_first = list(dict.fromkeys([*first_last, *first_only]))
    aggs = [F.count(F.lit(1)).alias("__n")]
    if from_first:
        aggs.append(F.min_by(F.struct(*from_first), "__ord").alias("__first"))
    if first_last:
        aggs.append(F.max_by(F.struct(*first_last), "__ord").alias("__last"))
    aggs += [strict_max(c).alias(f"__max_{c}") for c in strict_max_cols]
    aggs += [F.avg(c).alias(f"__avg_{c}") for c in mean_cols]
    g = df.groupBy(*keys).agg(*aggs)
    out = [F.col("__n").alias(n_col)]
    for c in first_last:
        out.append(F.col("__first")[c].alias(f"{c}_1"))
        out.append(F.when(F.col("__n") > 1, F.col("__last")[c]).alias(f"{c}_2"))
    out += [F.col("__first")[c].alias(c) for c in first_only]
    out += [F.col(f"__max_{c}").alias(c) for c in strict_max_cols]
    out += [F.col(f"__avg_{c}").alias(c) for c in mean_cols]
    return g.select(*keys, *out)


def mean_indicators(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Group mean of 0/1 indicators ignoring NULL; all-NULL -> NULL."""
    return df.groupBy(*keys).agg(*[F.avg(c).cast("double").alias(c) for c in cols])


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def value_counts(df: DataFrame, c: str, levels: DataFrame | None = None,
                 level_col: str = "level", sort: str | None = None) -> DataFrame:
    """Count per value, NULL included.  With a level table, levels with no
    rows count 0 (the level table is the small side of a left join).
    ``sort``: ``"level_desc"`` (by level, descending) or ``"n_desc"``."""
    counts = df.groupBy(F.col(c).alias(level_col)).agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        return _sorted_counts(counts, level_col, sort)
    joined = levels.join(counts, levels[level_col].eqNullSafe(counts[level_col]), "full")
    out = joined.select(
        F.coalesce(levels[level_col], counts[level_col]).alias(level_col),
        F.coalesce(counts["n"], F.lit(0)).cast("bigint").alias("n"),
        *[levels[x] for x in levels.columns if x != level_col])
    return _sorted_counts(out, level_col, sort)


def _sorted_counts(df: DataFrame, level_col: str, sort: str | None) -> DataFrame:
    if sort == "level_desc":
        return df.orderBy(F.col(level_col).desc_nulls_last())
    if sort == "n_desc":
        return df.orderBy(F.col("n").desc(), F.col(level_col).asc_nulls_last())
    return df


def top_values(df: DataFrame, c: str, k: int = 30) -> DataFrame:
    """Top-k frequency table: count desc, value as tiebreak.  ``limit`` is
    the feature here; Spark plans a TakeOrderedAndProject (per-partition
    top-k, then merge)."""
    return (df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k))


def spread_nth(df: DataFrame, keys: list[str], value: str, order_by, n: int = 2,
               prefix: str | None = None) -> DataFrame:
    """Number records within subject by order and spread ``value`` of
    records 1..n into ``value_1..value_n`` (pivot as conditional aggregates).

    The ``rn <= n`` filter lets Spark plan a partial ``WindowGroupLimit``
    before the shuffle: each map task forwards at most ``n`` rows per
    subject, so a hot subject does not move whole."""
    prefix = prefix or value
    w = Window.partitionBy(*keys).orderBy(*window_order(order_by))
    r = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return r.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"{prefix}_{i}")
        for i in range(1, n + 1)])


def type_or_both(df: DataFrame, keys: list[str], c: str, both: str = "both",
                 overrides: DataFrame | None = None, override_col: str = "label") -> DataFrame:
    """Per subject: the single value of ``c``, or ``both`` when the subject's
    records disagree (``min != max``: partially aggregable, unlike a
    distinct count).  ``overrides`` (key columns + label) wins when given;
    it is a patch table joined without a hint (AQE broadcasts it when
    small)."""
    g = df.groupBy(*keys).agg(
        F.when(F.min(c) != F.max(c), F.lit(both)).otherwise(F.min(c)).alias(c))
    if overrides is None:
        return g
    j = g.join(overrides, on=keys, how="left")
    return j.select(*keys, F.coalesce(F.col(override_col), F.col(c)).alias(c))
