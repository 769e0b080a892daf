"""Order keys as comparable structs, so "first row by order" can be an
aggregate (``min_by``) instead of a window.

An aggregate is partially evaluated on the map side: a subject that holds a
third of all rows is reduced to one candidate per map task before the
shuffle, while a window would pull the whole group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def reversed_text(c: Column) -> Column:
    """A text whose ascending order is the descending (byte-wise) order of ``c``: its UTF-8 bytes in hexadecimal
    digits, each digit taken from F, and a last sign above all digits, so that a prefix comes behind what it
    begins.  Texts and binary columns."""
    return F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def normalize_order(order_by) -> list[tuple[str, str]]:
    out = []
    for item in order_by:
        if isinstance(item, str):
            out.append((item, "asc"))
        else:
            out.append((item[0], item[1]))
    return out


def order_struct(df: DataFrame, order_by) -> Column | None:
    """Struct whose ascending order equals the requested order with NULLs
    last in both directions (rule N9).  Every atomic type has one: whole
    numbers and dates are turned about by bitwise not, which has no overflow,
    texts by :func:`reversed_text`.  ``None`` for a descending nested column
    (callers then use a window)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for i, (name, how) in enumerate(normalize_order(order_by)):
        c = F.col(name)
        fields.append(c.isNull().alias(f"n{i}"))
        if how == "asc":
            fields.append(c.alias(f"v{i}"))
            continue
        t = types[name]
        if isinstance(t, _WHOLE):
            v = F.bitwise_not(c)
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            fields.append((~F.isnan(c)).alias(f"f{i}"))  # NaN is the largest number
            v = -c
        elif isinstance(t, T.DecimalType):
            v = -c
        elif isinstance(t, T.DateType):
            v = F.bitwise_not(F.unix_date(c))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            v = F.bitwise_not(F.unix_micros(c.cast("timestamp")))
        elif isinstance(t, T.BooleanType):
            v = ~c
        elif isinstance(t, (T.StringType, T.BinaryType)):
            v = reversed_text(c)
        else:
            return None
        fields.append(v.alias(f"v{i}"))
    return F.struct(*fields)


def window_order(order_by) -> list[Column]:
    out = []
    for name, how in normalize_order(order_by):
        out.append(F.col(name).desc_nulls_last() if how == "desc" else F.col(name).asc_nulls_last())
    return out
