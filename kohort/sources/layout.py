"""Cleaned tables laid out by their subject key (survey A5, D1-D4).

A table is written once in buckets of a hash of its key, each bucket sorted:
joins by the key and aggregates over it then read the buckets as they lie,
without an exchange, however many such steps follow.  The key of the buckets
is a text that is never null (``KEY``), so that a plain equality joins NULL to
NULL and Spark can use the buckets, which a null-safe equality doesn't allow.

A bucket is one task's work.  The writer therefore counts the rows of each key
first; where one key holds more than a bucket should (a third of the table,
say), the table is written without buckets.  Its joins then shuffle, and
adaptive execution splits the hot key.  The results are the same.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.nulls import qcol
from kohort.session import materialize
from kohort.sources.io import sql_string

KEY = "layout_key"
LAYOUT = "_layout"  # beside the data files; readers of the table skip names that start with a line


def layout_key(keys: list[str]) -> Column:
    """One text for the values of ``keys``; equal where all are equal, NULL to NULL."""
    def part(c):
        text = qcol(c).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return F.concat(*[part(c) for c in keys])


def write_laid_out(df: DataFrame, path: str, keys: list[str], buckets: int | None = None, max_share: float = 4.0) -> DataFrame:
    """Write ``df`` at ``path`` in buckets of ``keys`` and return it as ``read_laid_out`` does.

    ``buckets`` is the number of shuffle partitions if not given; tables that
    are to meet without an exchange need the same one.  If a key has more rows
    than ``max_share`` buckets hold on average (and more than 10,000), the table
    is written without buckets.  Keys may be null; a table without rows will do.
    """
    spark = df.sparkSession
    if not keys or KEY in df.columns:
        raise ValueError(f"needs keys, and no column named {KEY}: {df.columns}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(KEY, layout_key(keys))
    counts = materialize(keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")))  # combined map-side
    most, total = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    even = most <= max(10_000, max_share * total / buckets)
    layout = spark.range(1).select(F.lit(buckets if even else 0).alias("buckets"),
                                   F.array(*map(F.lit, keys)).alias("keys"), F.lit(keyed.schema.json()).alias("schema"))
    if even:
        name = _name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one task for each bucket, so that a bucket is one sorted file
        (keyed.repartition(buckets, KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
         .option("path", path).saveAsTable(name))
    else:
        keyed.write.mode("overwrite").parquet(path)
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/{LAYOUT}")
    return read_laid_out(spark, path)


def read_laid_out(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_laid_out``, also of another session: its columns and ``KEY``."""
    buckets, _, schema = spark.read.parquet(f"{path}/{LAYOUT}").first()
    fields = _schema(schema)
    if not buckets:
        return spark.read.schema(fields).parquet(path)
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                  f"INTO {buckets} BUCKETS LOCATION {sql_string(path)}")
    return spark.table(name)


def join_laid_out(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join of two laid-out tables on the ``keys`` of their layout, NULL to NULL, as ``natural_join`` does.

    ``KEY`` stays, so that further joins use the buckets too.  Columns that
    both sides have besides the keys are refused; ``how`` is left or inner.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    both = {c for c in left.columns if c in set(right.columns)} - {KEY, *keys}
    if both or KEY not in left.columns or KEY not in right.columns:
        raise ValueError(f"not laid out, or columns on both sides: {sorted(both)}")
    return left.join(right.drop(*keys), KEY, how)


def summary_laid_out(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row for each value of the layout's ``keys`` with ``aggregates``, from the buckets as they lie; ``KEY`` stays."""
    return df.groupBy(KEY, *[qcol(k) for k in keys]).agg(*aggregates)


def _name(path: str) -> str:
    return "laid_out_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def _schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))
