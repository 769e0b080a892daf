"""Small document tables for the corpus operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def clashing(df):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    names = ["fp", "k_id", "k_text", "k_null", "a", "b", "key", "pos", "chunk", "n", "spans", "lang_pred", "ids"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})
