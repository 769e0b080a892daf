"""Natural (all common columns) null-safe equi joins (survey section 2.4).

Join keys match NULL to NULL (rule N10) through ``<=>``; Spark still
extracts hash keys from a null-safe equality, so the plan is a sort-merge
or (AQE-chosen) broadcast hash join, never a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    rset = set(right.columns)
    return [c for c in left.columns if c in rset]


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` with NULL = NULL; key columns appear once (left's)."""
    if not keys:
        raise ValueError("no join keys")
    ln = left.alias("__l")
    rn = right.alias("__r")
    cond = reduce(lambda a, b: a & b,
                  [ln[f"`{k}`"].eqNullSafe(rn[f"`{k}`"]) for k in keys])
    j = ln.join(rn, cond, how)
    keyset = set(keys)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return j
    from pyspark.sql import functions as F
    key_cols = []
    for k in keys:
        if how in ("right", "right_outer"):
            key_cols.append(F.col(f"__r.`{k}`").alias(k))
        elif how in ("full", "outer", "full_outer"):
            key_cols.append(F.coalesce(F.col(f"__l.`{k}`"), F.col(f"__r.`{k}`")).alias(k))
        else:
            key_cols.append(F.col(f"__l.`{k}`").alias(k))
    out = []
    for c in left.columns:
        out.append(key_cols[keys.index(c)] if c in keyset else F.col(f"__l.`{c}`"))
    out += [F.col(f"__r.`{c}`") for c in right.columns if c not in keyset]
    return j.select(*out)


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column name the two sides share, NULL-safe; rows of
    the left side multiply when the right side repeats a key."""
    return join_null_safe(left, right, common_columns(left, right), how)
