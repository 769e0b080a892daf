"""Factor level tables.

A categorical column keeps its values as strings; its level order lives in
a small side table ``(level, ord)``.  Level order decides display order,
the reference group of a model, and factor sort order.

Level tables are built from the distinct values, which are written once and
counted.  Up to ``SMALL`` of them are numbered in one window; more with the
range-partitioned row numbering, so a column of any cardinality is never
held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.operators.dedup import row_number_col
from kohort.operators.ordering import window_order
from kohort.session import materialize

SMALL = 10_000  # levels that one task numbers


def _numbered(values: DataFrame, order) -> DataFrame:
    """``values`` with ``ord``, their number from 1 by ``order``."""
    held = materialize(values)
    if held.count() > SMALL:
        return row_number_col(held, [], order, "ord")
    return held.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*window_order(order))).cast("bigint"))


def levels_from(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct non-NULL values -> ``(level, ord)``, ord from 1."""
    values = df.select(F.col(c).cast("string").alias("level")).filter("level IS NOT NULL").distinct()
    return _numbered(values, ["level"])


def levels_by_freq(df: DataFrame, c: str) -> DataFrame:
    """Levels by decreasing frequency (ties alphabetical)."""
    counts = (df.filter(F.col(c).isNotNull())
                .groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("__n")))
    return _numbered(counts, [("__n", "desc"), "level"]).select("level", "ord")


def levels_literal(spark, levels: list[str]) -> DataFrame:
    """Level table from an explicit list (its order is the level order)."""
    return spark.createDataFrame([(lv, i + 1) for i, lv in enumerate(levels)], "level string, ord bigint")


def relevel(levels: DataFrame, first: list[str] = (), last: list[str] = ()) -> DataFrame:
    """Move ``first`` levels to the front (in the given order) and ``last``
    levels to the end; others keep their relative order."""
    first, last = list(first), list(last)
    key = F.col("ord").cast("double")
    for i, lv in enumerate(first):
        key = F.when(F.col("level") == lv, F.lit(float(i - len(first) - 1e9))).otherwise(key)
    for i, lv in enumerate(last):
        key = F.when(F.col("level") == lv, F.lit(float(1e18 + i))).otherwise(key)
    return renumber(levels.withColumn("__k", key), "__k")


def renumber(levels: DataFrame, key: str = "ord") -> DataFrame:
    """Dense 1..k ``ord`` following ``key``."""
    return _numbered(levels.select("level", F.col(key).alias("__key")), ["__key", "level"]).select("level", "ord")


def drop_unused_levels(levels: DataFrame, df: DataFrame, c: str) -> DataFrame:
    """Remove levels with no rows in ``df`` and renumber."""
    used = df.select(F.col(c).cast("string").alias("level"))
    return renumber(levels.join(used, on="level", how="left_semi"))
