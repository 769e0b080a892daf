"""Running (prefix / suffix) aggregates over an ordered key without a
single-partition window.

Survival curves, risk sets, mid-ranks and row numbers all need a
cumulative sum over a sorted key.  ``Window.orderBy`` without
``partitionBy`` would pull every row into one task, so the key is split
into range buckets:

1. a window inside each bucket (partitioned by partition x bucket) gives
   the local prefix and the bucket total,
2. one row per bucket, and an exclusive prefix over the buckets (a window
   over that small table),
3. the offsets joined back to the windowed rows.

Steps 1-3 read the input through one hash partitioning (partition x
bucket); step 2 needs no new shuffle of the rows, and AQE reuses the
exchange when a branch repeats it.  Step 2's table has ``#partitions x #buckets`` rows; it is
joined back without a broadcast hint, so AQE picks broadcast only when the
measured size allows it.  Inputs must be unique on ``(partition_cols, order_col)``
(callers collapse first), so row frames are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.operators.joins import join_null_safe

_BUCKET = "__bucket"
ONE = {"one_bucket": True}   # metadata of a bucket column that has one value only
ROWS_PER_BUCKET = 4          # fewer rows than this a bucket are not worth splitting
MAX_BORDERS = 1_000_000      # numbers that a table of borders may hold to be broadcast: 8 MB


def _bucket_expr(order_col: str, bucket_width: float):
    return F.floor(F.col(order_col) / F.lit(float(bucket_width))).cast("bigint")


def running_aggs(df: DataFrame, partition_cols: list[str], order_col: str,
                 sums: dict[str, str] | None = None,
                 products: dict[str, str] | None = None,
                 suffix_sums: dict[str, str] | None = None,
                 bucket_width: float | None = None, bucket_col: str | None = None,
                 within_order: list | None = None, n_buckets: int = 1024) -> DataFrame:
    """Add cumulative columns.

    ``sums``        out_name -> column: inclusive prefix sum (order ascending)
    ``products``    out_name -> column: inclusive prefix product
    ``suffix_sums`` out_name -> column: inclusive suffix sum (rows with key >= own)

    Buckets are a precomputed ``bucket_col`` (non-decreasing in the order
    key), else ``floor(order / bucket_width)`` when a width is given, else
    ``n_buckets`` ranges of about equally many rows per partition (see
    :func:`scaled_buckets`; the bucket table stays <= n_buckets rows per
    partition).
    ``within_order`` (sort Columns) replaces ``order_col`` inside a bucket,
    for composite orders whose first key drives the bucket.
    """
    sums = dict(sums or {})
    products = dict(products or {})
    suffix_sums = dict(suffix_sums or {})
    part = list(partition_cols)
    if bucket_col is not None:
        b = df.withColumn(_BUCKET, F.col(bucket_col))  # caller's column is kept
    elif bucket_width is not None:
        b = df.withColumn(_BUCKET, _bucket_expr(order_col, bucket_width))
    else:
        b = scaled_buckets(df, part, order_col, n_buckets, name=_BUCKET)

    if b.schema[_BUCKET].metadata == ONE:
        # small partitions (checked by scaled_buckets): the window inside the bucket is the whole answer
        wi = Window.partitionBy(*part, _BUCKET).orderBy(*(within_order or [order_col]))
        upto, onward = wi.rowsBetween(Window.unboundedPreceding, 0), wi.rowsBetween(0, Window.unboundedFollowing)
        return b.withColumns({**{n: F.sum(c).over(upto) for n, c in sums.items()},
                              **{n: F.product(c).over(upto) for n, c in products.items()},
                              **{n: F.sum(c).over(onward) for n, c in suffix_sums.items()}}).drop(_BUCKET)

    # 1. in-bucket window: local inclusive prefix and bucket total, both on
    #    the (partition, bucket) hash partitioning
    wi = Window.partitionBy(*part, _BUCKET).orderBy(*(within_order or [order_col]))
    upto = wi.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_b = wi.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order: same rounding each run
    loc = {}
    for name, c in {**sums, **suffix_sums}.items():
        loc[f"__lp_{name}"] = F.sum(c).over(upto)
        loc[f"__bt_{name}"] = F.sum(c).over(whole_b)
    for name, c in products.items():
        loc[f"__lp_{name}"] = F.product(c).over(upto)
        loc[f"__bt_{name}"] = F.product(c).over(whole_b)
    local = b.withColumns(loc)

    # 2. one row per bucket (the input is already partitioned by it, so no
    #    shuffle), exclusive prefix over buckets: a table of
    #    #partitions x #buckets rows
    bt = [f"__bt_{n}" for n in [*sums, *suffix_sums, *products]]
    totals = local.groupBy(*part, _BUCKET).agg(*[F.first(c).alias(c) for c in bt])
    wb = Window.partitionBy(*part).orderBy(_BUCKET)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offs = []
    for name in [*sums, *suffix_sums]:
        offs.append(F.coalesce(F.sum(f"__bt_{name}").over(before), F.lit(0)).alias(f"__off_{name}"))
    for name in suffix_sums:
        offs.append(F.sum(f"__bt_{name}").over(whole).alias(f"__tot_{name}"))
    for name in products:
        offs.append(F.coalesce(F.product(f"__bt_{name}").over(before), F.lit(1.0)).alias(f"__off_{name}"))
    offsets = totals.select(*part, _BUCKET, *offs)

    # 3. join the offsets back (the windowed side keeps its partitioning;
    #    AQE broadcasts the small offsets table when its size allows)
    joined = join_null_safe(local.drop(*bt), offsets, [*part, _BUCKET], "inner")
    cols = {}
    for name, c in sums.items():
        cols[name] = F.col(f"__off_{name}") + F.col(f"__lp_{name}")
    for name, c in products.items():
        cols[name] = F.col(f"__off_{name}") * F.col(f"__lp_{name}")
    for name, c in suffix_sums.items():
        # rows with key >= own = total - (rows before the bucket) - (rows before
        # this one inside the bucket)
        cols[name] = (F.col(f"__tot_{name}") - F.col(f"__off_{name}")
                      - (F.col(f"__lp_{name}") - F.coalesce(F.col(c), F.lit(0))))
    out = joined.withColumns(cols)
    drop = [c for c in out.columns if c.startswith(("__off_", "__tot_", "__lp_"))]
    return out.drop(*drop, _BUCKET)


def range_bucket(value, cuts, most: int):
    """How many of the sorted ``cuts`` (at most ``most``) lie below ``value``, by binary search."""
    steps = [1 << k for k in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        F.get(cuts, at + step - 1) < value, at + step).otherwise(at)).cast("bigint")


def scaled_buckets(df: DataFrame, partition_cols: list[str], order_col: str,
                   n_buckets: int = 1024, name: str = "__qb") -> DataFrame:
    """Add ``name`` = range bucket of ``order_col`` within each partition.

    Borders are the partition's quantiles (``percentile_approx``, combined
    before the shuffle), so a bucket holds about 1 / ``n_buckets`` of the
    partition's rows whatever the scale and however far its outliers lie.
    A partition's borders are one array of at most ``n_buckets`` - 1
    numbers; the arrays are broadcast, as a shuffle by the partition columns
    would put each partition's rows into one task.  Without partition columns,
    or with more of them than ``MAX_BORDERS`` allows, the borders are those of
    all rows, read once and put in the plan; no bucket of a partition then
    holds more than about 1 / ``n_buckets`` of all rows.

    The rows are counted first: where no partition has more than
    ``ROWS_PER_BUCKET * n_buckets`` of them, all are one bucket, which
    :func:`running_aggs` sums in one window."""
    part = list(partition_cols)
    if n_buckets > 1:
        sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).first()
    if n_buckets <= 1 or (sizes["most"] or 0) <= ROWS_PER_BUCKET * n_buckets:
        return df.withColumn(name, F.lit(0).cast("bigint")).withMetadata(name, ONE)
    value = F.col(order_col).cast("double")
    probs = [k / n_buckets for k in range(1, n_buckets)] or [0.5]
    found = F.array_distinct(F.percentile_approx(value, probs, max(10_000, 10 * n_buckets)))
    if not part or sizes["parts"] * n_buckets > MAX_BORDERS:
        cuts = df.agg(found.alias("cuts")).first()["cuts"] or []
        return df.withColumn(name, F.coalesce(range_bucket(value, F.lit(cuts).cast("array<double>"), len(probs)), F.lit(0)))
    j = join_null_safe(df, F.broadcast(df.groupBy(*part).agg(found.alias("__cuts"))), part, "inner")
    return j.withColumn(name, F.coalesce(range_bucket(value, F.col("__cuts"), len(probs)), F.lit(0))).drop("__cuts")
