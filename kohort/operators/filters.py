"""Row filters with the source's NULL semantics (survey 2.3).

Plain comparisons on scan columns reach Parquet as pushed filters; dates
are compared as DATE literals so row-group statistics apply.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.nulls import rlike_or_false


def exclude_value(df: DataFrame, c: str, value) -> DataFrame:
    """``c != value``; rows where ``c`` is NULL are dropped too."""
    return df.filter(F.col(c) != F.lit(value))


def exclude_bad_records(df: DataFrame, key: str, drop_ids: DataFrame | None = None,
                        conditional: list[tuple] = ()) -> DataFrame:
    """Drop every row of the ids in ``drop_ids`` (a one-column table, an
    anti join that AQE broadcasts when small), and rows of an id whose text
    column matches a pattern: ``conditional = [(id, column, regex)]``."""
    out = df
    if drop_ids is not None:
        ids = drop_ids.select(F.col(drop_ids.columns[0]).alias(key))
        out = out.join(ids, on=key, how="left_anti")
    for ident, c, pattern in conditional:
        out = out.filter(~((F.col(key) == F.lit(ident)) & rlike_or_false(c, pattern)))
    return out


def require_not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def in_period(df: DataFrame, c: str, lo=None, hi=None, lo_open=False, hi_open=False) -> DataFrame:
    """Calendar-date range filter; each bound closed unless ``*_open``.

    On a timestamp column the bounds are rewritten as timestamp literals
    (``day(ts) <= hi`` becomes ``ts < hi + 1 day``) so the comparison stays
    on the raw column and reaches the Parquet scan as a pushed filter; a
    cast of the column would block the pushdown.
    """
    col = F.col(c)
    dtype = df.schema[c].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        tname = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"

        def ts(day, plus_one=False):
            dd = _dt.date.fromisoformat(str(day)) + _dt.timedelta(days=1 if plus_one else 0)
            return F.lit(f"{dd.isoformat()} 00:00:00").cast(tname)
        if lo is not None:
            df = df.filter(col >= ts(lo, plus_one=lo_open))
        if hi is not None:
            df = df.filter(col < ts(hi, plus_one=not hi_open))
        return df
    if lo is not None:
        lo_d = F.lit(lo).cast("date")
        df = df.filter(col > lo_d if lo_open else col >= lo_d)
    if hi is not None:
        hi_d = F.lit(hi).cast("date")
        df = df.filter(col < hi_d if hi_open else col <= hi_d)
    return df


def at_least_or_null(df: DataFrame, c: str, k) -> DataFrame:
    """Keep ``c >= k`` or ``c IS NULL``."""
    return df.filter((F.col(c) >= F.lit(k)) | F.col(c).isNull())
