"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.session import checkpoint_dir


def ship(module: str) -> None:
    """Send the task code of ``module`` with each job, so that executors need
    numpy and pandas but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Three non-null columns that identify a document.

    Rows that repeat both the doc_id and the text are one document: every
    operator gives them the same result.  Rows that share only a doc_id, or
    have none, are told apart by the hash of their text.
    """
    return [F.col(doc_id).isNull().alias("k_null"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("k_text")]


ROW_ID = ["k_null", "k_id", "k_text"]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once.

    A column that is named inside a lambda may be put there as an expression
    and computed again for each element; a lambda's variable is a value.
    """
    return F.get(F.transform(F.array(value), body), 0)


def packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): whole rows as one struct beside what the operators read, so that further
    columns of ``docs`` may have any name.  ``doc.*`` gives the rows back."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("doc"), "doc_id", "text")


def hash_share(key: Column, wanted: int, total: int) -> Column:
    """Whether a row is among a share of about twice ``wanted`` of ``total`` rows, told by a hash of ``key``.

    For samples of a bounded size: an ordered limit keeps ``wanted`` rows of every partition until the last
    step; behind this filter they are few in all, however many partitions there are."""
    part = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(part)) < min(part, 2 * wanted * part // max(1, total) + 1)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: like a checkpoint it cuts the lineage,
    but columns are compressed, which matters for texts and arrays."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
