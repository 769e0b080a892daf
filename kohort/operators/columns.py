"""Header normalisation, renaming and column selectors (survey 2.2).

All of these are schema-time: they compute a list of names from
``df.columns`` / ``df.schema`` and emit one projection.  No data moves.
"""

from __future__ import annotations

import re
import unicodedata
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.nulls import qcol


# --- header normalisation ----------------------------------------------------

def snake_name(name: str) -> str:
    """One header -> snake_case ASCII: accents stripped, "%" -> percent,
    "#" -> number, camelCase split, other punctuation -> "_", leading digit
    prefixed with "x"."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_name_list(names: list[str]) -> list[str]:
    """Normalise and de-duplicate: the 2nd and later clash get _2, _3..."""
    out, seen = [], {}
    for n in names:
        b = snake_name(n)
        k = seen.get(b, 0) + 1
        seen[b] = k
        out.append(b if k == 1 else f"{b}_{k}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_name_list(df.columns))


# --- renaming ----------------------------------------------------------------

def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``{new: old}`` bulk rename; unknown old names raise (Spark would
    silently ignore them)."""
    missing = [old for old in mapping.values() if old not in df.columns]
    if missing:
        raise KeyError(f"rename: unknown columns {missing}")
    return df.withColumnsRenamed({old: new for new, old in mapping.items()})


def select_rename(df: DataFrame, spec) -> DataFrame:
    """Ordered projection; items are ``"col"`` or ``("new", "old")``."""
    cols = []
    for item in spec:
        if isinstance(item, str):
            cols.append(qcol(item))
        else:
            new, old = item
            cols.append(qcol(old).alias(new))
    return df.select(*cols)


# --- selectors -----------------------------------------------------------------

class Sel:
    """A column selector resolved against the current column order.

    Combine with ``|`` (union), ``&`` (intersection) and ``~`` (negation);
    results keep first-occurrence order without duplicates.
    """

    def __init__(self, fn: Callable[[DataFrame], list[str]]):
        self.fn = fn

    def resolve(self, df: DataFrame) -> list[str]:
        return self.fn(df)

    def __or__(self, other: "Sel") -> "Sel":
        def f(df):
            a = self.resolve(df)
            return a + [c for c in other.resolve(df) if c not in a]
        return Sel(f)

    def __and__(self, other: "Sel") -> "Sel":
        def f(df):
            b = set(other.resolve(df))
            return [c for c in self.resolve(df) if c in b]
        return Sel(f)

    def __invert__(self) -> "Sel":
        def f(df):
            a = set(self.resolve(df))
            return [c for c in df.columns if c not in a]
        return Sel(f)


def names(*cols: str) -> Sel:
    def f(df):
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"unknown columns {missing}")
        return list(cols)
    return Sel(f)


def starts_with(prefix: str, ignore_case: bool = True) -> Sel:
    p = prefix.lower() if ignore_case else prefix
    return Sel(lambda df: [c for c in df.columns
                           if (c.lower() if ignore_case else c).startswith(p)])


def ends_with(suffix: str, ignore_case: bool = True) -> Sel:
    s = suffix.lower() if ignore_case else suffix
    return Sel(lambda df: [c for c in df.columns
                           if (c.lower() if ignore_case else c).endswith(s)])


def contains(text: str, ignore_case: bool = True) -> Sel:
    t = text.lower() if ignore_case else text
    return Sel(lambda df: [c for c in df.columns if t in (c.lower() if ignore_case else c)])


def matches(pattern: str) -> Sel:
    rx = re.compile(pattern, re.IGNORECASE)
    return Sel(lambda df: [c for c in df.columns if rx.search(c)])


_KINDS = {
    "numeric": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                T.DoubleType, T.DecimalType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
}


def where_type(kind: str) -> Sel:
    kinds = _KINDS[kind]
    return Sel(lambda df: [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)])


def between(first: str, last: str) -> Sel:
    """Inclusive positional range ``first:last`` in the current order."""
    def f(df):
        cols = df.columns
        i, j = cols.index(first), cols.index(last)
        if i > j:
            i, j = j, i
        return cols[i:j + 1]
    return Sel(f)


def cols(df: DataFrame, *selectors) -> list[str]:
    """Resolve selectors (``Sel`` or plain names) to an ordered name list."""
    out: list[str] = []
    for s in selectors:
        got = s.resolve(df) if isinstance(s, Sel) else [s]
        out += [c for c in got if c not in out]
    return out


def select_cols(df: DataFrame, *selectors) -> DataFrame:
    return df.select(*[qcol(c) for c in cols(df, *selectors)])


def drop_cols(df: DataFrame, *selectors) -> DataFrame:
    return df.drop(*cols(df, *selectors))


def mutate_across(df: DataFrame, selector, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to many columns in place (one projection)."""
    targets = cols(df, selector) if not isinstance(selector, (list, tuple)) else list(selector)
    return df.withColumns({c: fn(qcol(c)) for c in targets})


def final_projection(df: DataFrame, selectors, identifiers=()) -> DataFrame:
    """Ordered analysis projection; refuses to emit direct identifiers."""
    out = cols(df, *selectors)
    leaked = [c for c in out if c in set(identifiers)]
    if leaked:
        raise ValueError(f"identifier columns must not be exported: {leaked}")
    return df.select(*[qcol(c) for c in out])
