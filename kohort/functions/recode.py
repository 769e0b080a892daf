"""Scalar recodes (survey section 2.9, I1-I10, I16, I20, I23-I25).

All helpers return ``Column`` expressions: they compile into the
surrounding whole-stage-codegen projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohort.functions.nulls import _c, if_else, if_else_missing, isin_or_false, rlike_or_false


def recode2(cond: Column, yes, no, missing=None, has_missing: bool = False) -> Column:
    """Binary recode.  Without ``has_missing`` a NULL test stays NULL (N1);
    with it, a NULL test yields ``missing`` (N2)."""
    if has_missing:
        return if_else_missing(cond, yes, no, missing)
    return if_else(cond, yes, no)


def recode_regex(c, pattern: str, yes, no) -> Column:
    """``yes`` when ``c`` matches ``pattern``; NULL text takes ``no``."""
    return F.when(rlike_or_false(c, pattern), yes).otherwise(no)


def case_map(branches, default=None) -> Column:
    """Chained CASE WHEN; a NULL test is "no match"; no default -> NULL."""
    expr = None
    for cond, value in branches:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def substr_inclusive(c, start: int, end: int) -> Column:
    """Characters ``start..end`` (1-based, inclusive)."""
    return F.substring(_c(c), start, end - start + 1)


def split_first(c, sep: str) -> tuple[Column, Column]:
    """Split at the first ``sep`` only: (head, rest); rest NULL if absent."""
    parts = F.split(_c(c), re.escape(sep), 2)
    return F.get(parts, 0), F.get(parts, 1)


def title_case(c, breaks: str = "space") -> Column:
    """Title case.  ``breaks="space"``: Spark's ``initcap`` (words split at
    spaces).  ``breaks="nonletter"``: a letter is capitalised when it starts
    the text or follows any non-letter ("nandu-x" -> "Nandu-X"), as word-
    boundary title casing does; computed JVM-side over the whole text with
    a higher-order function on its characters."""
    if breaks == "space":
        return F.initcap(_c(c))
    chars = F.split(F.lower(_c(c)), "")
    out = F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(ch)).otherwise(ch))
    return F.when(_c(c).isNull(), F.lit(None)).when(_c(c) == "", F.lit("")).otherwise(F.array_join(out, ""))


def to_number(c, to: str = "double") -> Column:
    """Lenient text -> number; text that is not a number becomes NULL."""
    return _c(c).try_cast(to)


def leading_grade(c, unknown=("Desconocido",)) -> Column:
    """Grade text such as "2 - ambulatory" -> 2; unknown token -> NULL;
    NULL stays NULL."""
    cond = _c(c).isin(list(unknown))
    return if_else(cond, F.lit(None).cast("double"),
                   to_number(F.substring(_c(c), 1, 1), "double"))


SPREADSHEET_EPOCH = "1899-12-30"


def to_date_lenient(c, formats=("yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """Spreadsheet serial day number or date text -> DATE; else NULL."""
    num = _c(c).try_cast("double")
    # day numbers of 0001-01-01 .. 9999-12-31; anything else is not a serial
    serial = F.when(num.between(-693593.0, 2958465.0),
                    F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), F.floor(num).cast("int")))
    alts = [F.try_to_date(_c(c), fmt) for fmt in formats]
    return F.coalesce(serial, *alts)


def age_band_labels(breaks) -> list[str]:
    b = list(breaks)
    return [f"{b[i]}-{b[i + 1] - 1}" for i in range(len(b) - 1)] + [f"{b[-1]}+"]


def age_bands(c, breaks=(18, 40, 60, 80)) -> Column:
    """Closed-open bands from ``breaks``; last band open-ended; below the
    first break or NULL -> NULL."""
    b = list(breaks)
    labels = age_band_labels(b)
    expr = None
    for i in range(len(b) - 1, -1, -1):
        cond = _c(c) >= b[i]
        expr = F.when(cond, labels[i]) if expr is None else expr.when(cond, labels[i])
    return expr


def count_bands(n, labels=("none", "one", "two or more"), unknown="unknown",
                exact_upto: int | None = None) -> Column:
    """0 / 1 / ... / more bands of a count, NULL -> ``unknown``.

    ``labels[i]`` is the band for ``n == i`` and the last label is for
    ``n > len(labels)-2``.  Fractional counts (means) match no exact band
    and fall to ``unknown`` (source quirk Q4)."""
    nl = len(labels)
    branches = [(_c(n) == i, labels[i]) for i in range(nl - 1)]
    branches.append((_c(n) > nl - 2, labels[-1]))
    branches.append((_c(n).isNull(), unknown))
    return case_map(branches, unknown)


def two_flag_class(a, b, yes="Si", no="No",
                   labels=("both", "first only", "second only", "none"),
                   default=None) -> Column:
    """Two yes/no flags -> four labels; anything else -> ``default``."""
    A, B = _c(a), _c(b)
    return case_map([
        ((A == yes) & (B == yes), labels[0]),
        ((A == yes) & (B == no), labels[1]),
        ((A == no) & (B == yes), labels[2]),
        ((A == no) & (B == no), labels[3]),
    ], default)


def text_flag(cols, include: str, exclude: str) -> Column:
    """TRUE when any of ``cols`` matches ``include`` and not ``exclude``
    (NULL text never matches, N5)."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | (rlike_or_false(c, include) & ~rlike_or_false(c, exclude))
    return cond


def any_true_kleene(conds) -> Column:
    """Three-valued OR of several tests."""
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return out


def severity(conds, yes="Grave", no="Leve") -> Column:
    """Kleene OR of the severity tests, then a NULL-propagating recode."""
    return if_else(any_true_kleene(conds), yes, no)
