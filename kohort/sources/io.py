"""Sources and sinks (survey section 2.1).

Raw registry extracts arrive as text with many spellings of "missing".
They are read with every column as a string, the missing tokens are turned
into NULL in one projection, and typing happens in a later step.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.nulls import qcol

# Missing-value tokens of the two cleaning pipelines.
NA_TOKENS_V1 = ["NA", "N/D", "Seleccione...", "No aplica", "Desconocido", "999", "-999"]
NA_TOKENS_V2 = ["NA", "N/D", "ND", "Seleccione...", "No aplica", "999", "-999", "cofaco", ""]

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str, fresh: bool = False) -> DataFrame:
    """One of the driver's parquet tables; columns are pruned lazily.

    The DataFrame handle (not data) is reused per session and path, so the
    file listing and footer schema are resolved once; ``fresh`` re-reads
    when the files may have changed."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (id(spark), path)
    if fresh or key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def nullify_tokens(df: DataFrame, tokens, cols: list[str] | None = None) -> DataFrame:
    """Map any of ``tokens`` to NULL in string columns (numbers compare as text).

    A single projection; the token set is a literal IN list.
    """
    tokens = [str(t) for t in tokens]
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[
        (F.when(F.coalesce(F.trim(qcol(c)).isin(tokens), F.lit(False)), F.lit(None).cast("string"))
          .otherwise(qcol(c)).alias(c)) if c in set(cols) else qcol(c)
        for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "csv", na_tokens=("NA",),
               schema: T.StructType | None = None, **options) -> DataFrame:
    """Read a raw extract with all columns as text and NULL-ify ``na_tokens``.

    CSV's ``nullValue`` takes a single token, so the set is applied as an
    expression right after the scan (still one stage, no shuffle).
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if fmt != "csv":
        df = df.select([qcol(c).cast("string").alias(c) for c in df.columns])
    return nullify_tokens(df, na_tokens)


def read_dataset(spark: SparkSession, root: str, part, fmt: str = "parquet", suffix: str = "") -> DataFrame:
    """Part ``part`` of a multi-part source: one directory (or file, whose
    ending ``suffix`` names) per part.  Only Spark's readers look at the path."""
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/{part}{suffix}")


def write_clean(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Persist a cleaned table as Parquet (types and NULLs survive)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def data_dictionary(df: DataFrame, exact: bool = True, path: str | None = None) -> DataFrame:
    """One row per column: position, name, type, NULL count, distinct count.

    Exact counts take the long form: each cell is a row of its column's
    position and value, with one value field for each type of the schema, so
    that a cell carries itself and not its row.  Cells are counted by
    (position, value), which combines map-side, and the counts by position:
    one shuffle of distinct values.  ``exact=False`` uses HLL++
    (``approx_count_distinct``) in one aggregate without that shuffle.  With
    ``path`` the dictionary is written there (Parquet) and read back.
    """
    fields = df.schema.fields
    stats = _exact_counts(df) if exact else _approx_counts(df)
    names = ", ".join(f"({i + 1}L, {sql_string(f.name)}, '{f.dataType.simpleString()}')" for i, f in enumerate(fields))
    columns = df.sparkSession.sql(f"SELECT * FROM VALUES {names} AS v(position, column_name, data_type)")
    out = columns.join(stats, "position", "left").select(
        "position", "column_name", "data_type",
        F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), F.lit("").alias("description"))
    if path is not None:
        return read_clean(df.sparkSession, write_clean(out, path))
    return out


def _exact_counts(df: DataFrame) -> DataFrame:
    """(position, n_missing, n_distinct); no row for a column of an empty table."""
    types: list = []
    for f in df.schema.fields:
        if f.dataType not in types:
            types.append(f.dataType)
    values = [f"v{k}" for k in range(len(types))]
    cells = []
    for i, f in enumerate(df.schema.fields):
        own = types.index(f.dataType)
        cells.append(F.struct(F.lit(i + 1).cast("bigint").alias("position"), qcol(f.name).isNull().alias("missing"),
                              *[(qcol(f.name) if k == own else F.lit(None).cast(t)).alias(values[k])
                                for k, t in enumerate(types)]))
    long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    counted = long.groupBy("position", "missing", *values).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("position").agg(F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("n_missing"),
                                           F.count_if(~F.col("missing")).alias("n_distinct"))


def _approx_counts(df: DataFrame) -> DataFrame:
    aggs = []
    for i, f in enumerate(df.schema.fields):
        aggs += [F.count_if(qcol(f.name).isNull()).alias(f"n{i}"), F.approx_count_distinct(qcol(f.name)).alias(f"d{i}")]
    parts = ", ".join(f"{i + 1}L, n{i}, d{i}" for i in range(len(df.columns)))
    return df.agg(*aggs).selectExpr(f"stack({len(df.columns)}, {parts}) AS (position, n_missing, n_distinct)")


def sql_string(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
