"""NULL and ordering rules of the source analysis, as Column expressions.

The source language treats missing values differently from SQL in a few
places (an ``if_else`` on a missing test is missing, a regex test on a
missing string is false, sorts put missing last in both directions, join
keys match missing to missing).  Each helper here states one rule so the
operators never rely on Spark's defaults by accident.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column by its exact name, whatever characters it holds (raw headers
    carry dots, spaces and quotes before they are normalised)."""
    return F.col("`" + name.replace("`", "``") + "`")


def if_else(cond: Column, yes, no) -> Column:
    """NULL-propagating two-way choice: NULL condition gives NULL (rule N1)."""
    return F.when(cond, yes).when(~cond, no)


def if_else_missing(cond: Column, yes, no, missing) -> Column:
    """Two-way choice with an explicit result for a NULL condition."""
    return F.when(cond.isNull(), missing).when(cond, yes).otherwise(no)


def rlike_or_false(c, pattern: str) -> Column:
    """Regex test where a NULL string is simply 'no match' (N5)."""
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def isin_or_false(c, values: Iterable) -> Column:
    """Membership test where NULL is 'not a member' (N6)."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))


def asc_last(c) -> Column:
    """Ascending with NULL last."""
    return _c(c).asc_nulls_last()


def desc_last(c) -> Column:
    """Descending with NULL last."""
    return _c(c).desc_nulls_last()


def strict_max(c) -> Column:
    """Aggregate max that is NULL if any input is NULL."""
    return F.when(F.count(_c(c)) == F.count(F.lit(1)), F.max(_c(c)))


def strict_min(c) -> Column:
    """Aggregate min that is NULL if any input is NULL."""
    return F.when(F.count(_c(c)) == F.count(F.lit(1)), F.min(_c(c)))


def floor_div(a, b) -> Column:
    """Flooring integer division (N13); Spark ``div`` truncates."""
    return F.floor(_c(a) / _c(b)).cast("bigint")
