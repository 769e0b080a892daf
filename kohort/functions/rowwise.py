"""Horizontal reductions over indicator columns (I17-I19), as plain column
arithmetic: no per-row interpreter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_null_count(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols]).cast("bigint")


def row_sum(cols) -> Column:
    """Sum ignoring NULL; NULL when every column is NULL."""
    n = len(cols)
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    return F.when(row_null_count(cols) < n, s)


def row_any(cols) -> Column:
    """ceil(mean of 0/1 ignoring NULL) = logical OR; all-NULL -> NULL."""
    return F.greatest(*[F.col(c) for c in cols])
