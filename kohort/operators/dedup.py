"""First-per-key, row numbering, group-broadcast first/last, NULL-last
sorting (survey sections 2.6-2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.functions.nulls import qcol
from kohort.operators.joins import join_null_safe
from kohort.operators.ordering import order_struct, window_order
from kohort.operators.prefix import running_aggs
from kohort.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order_by) -> DataFrame:
    """Keep the first row per key by ``order_by`` (NULLs last).

    Preferred plan: ``min_by(struct(row), order_struct)`` grouped by key,
    a partial aggregate that keeps one candidate per key per map task, so a
    hot key does not land whole in one task.  A descending nested key
    (array, struct) falls back to ``row_number`` (Spark then plans a
    WindowGroupLimit).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordkey = order_struct(df, order_by)
    if ordkey is None:
        return first_per_key_window(df, keys, order_by)
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), ordkey).alias("__row"))
    return picked.select(*[F.col(k) for k in keys], "__row.*").select(*df.columns)


def first_per_key_window(df: DataFrame, keys: list[str], order_by) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*window_order(order_by))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def row_number_col(df: DataFrame, keys: list[str], order_by, name: str = "n",
                   n_ranges: int | None = None) -> DataFrame:
    """Row number within key by order (NULLs last), kept as a column.

    The rows are range-partitioned once by key and order and written with
    the number of their range (a reliable checkpoint); a running count by
    key over the ranges numbers them.  Spark samples the borders, so a key
    holding a third of all rows, far outliers and long common prefixes of
    texts all spread over many ranges.  Tied rows are told apart by a hash
    of the whole row.  ``n_ranges`` fixes the number of ranges, which is
    otherwise the session's number of shuffle partitions."""
    order = [*window_order(order_by), F.xxhash64(*[qcol(c) for c in df.columns])]
    count = [] if n_ranges is None else [n_ranges]
    ranges = df.repartitionByRange(*count, *[qcol(k) for k in keys], *order)
    held = materialize(ranges.withColumns({"__rb": F.spark_partition_id(), "__one": F.lit(1)}))
    out = running_aggs(held, list(keys), "__rb", sums={name: "__one"}, bucket_col="__rb", within_order=order)
    return out.select(*[qcol(c) for c in df.columns], name)


def flag_duplicated(df: DataFrame, keys: list[str], order_by, name: str = "is_dup") -> DataFrame:
    """TRUE on the 2nd and later record of a key (in ``order_by`` order)."""
    return row_number_col(df, keys, order_by, "__rn").withColumn(name, F.col("__rn") > 1).drop("__rn")


def first_last_over(df: DataFrame, keys: list[str], cols: list[str], order_by) -> DataFrame:
    """Repeat each group's first and last value of ``cols`` on every row.

    Computed as an aggregate joined back on the key (both sides hash
    partitioned on the key, so the join adds no extra exchange for the
    big side beyond the aggregate's own)."""
    ordkey = order_struct(df, order_by)
    if ordkey is None:
        w = (Window.partitionBy(*keys).orderBy(*window_order(order_by))
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumns({
            **{f"{c}_first": F.first(c, ignorenulls=False).over(w) for c in cols},
            **{f"{c}_last": F.last(c, ignorenulls=False).over(w) for c in cols}})
    o = df.withColumn("__ord", ordkey)
    g = o.groupBy(*keys).agg(
        *[F.min_by(F.struct(F.col(c).alias("v")), "__ord")["v"].alias(f"{c}_first") for c in cols],
        *[F.max_by(F.struct(F.col(c).alias("v")), "__ord")["v"].alias(f"{c}_last") for c in cols])
    return join_null_safe(df, g, list(keys), "inner")


def arrange(df: DataFrame, order_by) -> DataFrame:
    """Total sort with NULLs last in both directions (range-partitioned)."""
    return df.orderBy(*window_order(order_by))
