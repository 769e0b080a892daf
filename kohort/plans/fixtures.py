"""Registry-shaped fixtures derived from the driver's tables.

The driver's tables hold no NULLs, so NULLs are injected from keys.  Each
fixture exists twice: as a DataFrame builder (what the queries use) and as
SQL text valid in both Spark SQL and DuckDB (inlined as a CTE by oracles).
See FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.sources.io import table


def _date(s: str):
    return F.lit(s).cast("date")


# Row-level fixtures: one list of SQL expressions, used both by the Spark
# builders (``selectExpr``: one JVM call per column) and by the oracle text.
EXPRS = {
    "fx_rec": ("orders", [
        "o_custkey AS subject_id", "o_orderkey AS record_id", "CAST(o_orderdate AS DATE) AS dx_date",
        "DATE '1915-01-01' + CAST((o_custkey * 37) % 31000 AS INT) AS birth_date",
        "o_orderpriority AS code",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'local' "
        "WHEN o_orderstatus = 'O' THEN 'regional' ELSE 'distant' END AS stage",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' WHEN o_orderkey % 13 = 0 THEN NULL "
        "ELSE concat(CAST(o_orderkey % 5 AS STRING), ' - grade') END AS ecog_txt",
        "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 THEN NULL "
        "ELSE CAST(o_orderkey % 5 AS INT) END AS ecog",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'M8140' WHEN o_orderkey % 19 = 0 THEN NULL "
        "ELSE concat('M', CAST(8000 + o_orderkey % 900 AS STRING), '/3-adeno', "
        "CASE o_orderkey % 3 WHEN 0 THEN '-metas' WHEN 1 THEN '-metas inc' ELSE '' END) END AS morph",
    ]),
    "fx_sess": ("lineitem", [
        "l_orderkey AS subject_id", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS age",
        "CAST(l_shipdate AS DATE) AS session_date",
        "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS rtx_date",
    ]),
    "fx_tests": ("events", [
        "event_id", "user_id AS subject_id", "CAST(ts AS DATE) AS test_date",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS result", "value",
    ]),
    "fx_flags": ("orders", [
        "o_orderkey AS record_id", "o_custkey AS subject_id", "o_orderpriority AS grp",
        *[f"CASE WHEN o_orderkey % 50 = 0 OR (o_orderkey * 7 + {i} * 13) % 10 < 2 THEN NULL "
          f"WHEN (o_orderkey + {i} * 3) % {i + 2} = 0 THEN 1 ELSE 0 END AS co_f{i}" for i in range(1, 7)],
    ]),
    "fx_raw": ("orders", [
        "CAST(o_custkey AS STRING) AS id_pte", "CAST(o_orderkey AS STRING) AS num_registro",
        "concat('DOC-', CAST(o_custkey AS STRING)) AS num_doc",
        "CASE o_custkey % 5 WHEN 0 THEN 'N/D' WHEN 1 THEN 'Mujer' WHEN 2 THEN 'Mujer' ELSE 'Varón' END AS ptesxn_x",
        "CASE o_orderkey % 23 WHEN 0 THEN 'Benigno' WHEN 1 THEN 'Seleccione...' ELSE 'Maligno' END AS compn",
    ]),
    "fx_treat": ("orders", [
        "o_custkey AS subject_id", "o_orderkey AS record_id",
        "CASE o_custkey % 4 WHEN 0 THEN 'SI' WHEN 1 THEN 'si' WHEN 2 THEN 'no' ELSE 'N/D' END AS chemo",
        "CASE o_custkey % 3 WHEN 0 THEN 'si' WHEN 1 THEN 'NO' ELSE 'No aplica' END AS radio",
    ]),
    "fx_dirty": ("events", [
        "event_id",
        "CASE event_id % 10 WHEN 0 THEN 'N/D' WHEN 1 THEN '999' WHEN 2 THEN '' WHEN 3 THEN 'No aplica' "
        "WHEN 4 THEN 'abc' ELSE CAST(event_id AS STRING) END AS raw_num",
        "CASE event_id % 4 WHEN 0 THEN CAST(45292 + event_id % 30 AS STRING) "
        "WHEN 1 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 2 THEN 'Seleccione...' ELSE NULL END AS raw_date",
    ]),
}


def _from_exprs(spark: SparkSession, d: str, name: str) -> DataFrame:
    src, exprs = EXPRS[name]
    return table(spark, d, src).selectExpr(*exprs)


def fx_rec(spark: SparkSession, d: str) -> DataFrame:
    """Tumour registry: several records per subject."""
    return _from_exprs(spark, d, "fx_rec")


def fx_sess(spark: SparkSession, d: str) -> DataFrame:
    """Treatment sessions, many per subject."""
    return _from_exprs(spark, d, "fx_sess")


def fx_tests(spark: SparkSession, d: str) -> DataFrame:
    """Repeated tests per subject."""
    return _from_exprs(spark, d, "fx_tests")


FLAG_COLS = [f"co_f{i}" for i in range(1, 7)]


def fx_flags(spark: SparkSession, d: str) -> DataFrame:
    """Nullable 0/1 indicators (comorbidity analogue)."""
    return _from_exprs(spark, d, "fx_flags")


# The raw extract's headers as they come, in the order of fx_raw's columns.
RAW_HEADERS = ["ID Pte", "Núm. Registro", "Núm. Doc", "Ptesxn X", "COMPN"]


def fx_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw registry extract: text only, messy headers, missing-value tokens."""
    return _from_exprs(spark, d, "fx_raw").toDF(*RAW_HEADERS)


def fx_treat(spark: SparkSession, d: str) -> DataFrame:
    """Treatment flags, several rows per subject."""
    return _from_exprs(spark, d, "fx_treat")


def fx_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Missing-value tokens, non-numeric text, spreadsheet serial dates."""
    return _from_exprs(spark, d, "fx_dirty")


def fx_surv_dates(spark: SparkSession, d: str) -> DataFrame:
    """Right-censored survival, one row per customer (small).

    Orders are reduced to one row per customer before the join (the
    customer side then joins one row per key)."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    ev = F.when((F.col("o_orderpriority") == "1-URGENT")
                & (F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")),
                F.col("o_orderdate").cast("date"))
    per_cust = o.groupBy("o_custkey").agg(F.min(ev).alias("event_date"))
    j = c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left")
    return j.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("grp"),
                    F.when(F.col("c_acctbal") > 4500, "Si").otherwise("No").alias("exposed"),
                    "event_date")


def fx_surv_big_dates(spark: SparkSession, d: str) -> DataFrame:
    """Right-censored survival at line-item scale, one row per order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    ev = F.when((F.col("l_returnflag") == "R")
                & (F.col("l_shipdate") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")),
                F.col("l_shipdate").cast("date"))
    # lineitem is pre-aggregated to one row per order before the join
    per_order = li.groupBy("l_orderkey").agg(F.min(ev).alias("event_date"))
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "inner")
             .select(F.col("o_orderkey").alias("subject_id"), F.col("o_orderpriority").alias("grp"),
                     "event_date"))


def fx_entry(spark: SparkSession, d: str) -> DataFrame:
    """Delayed entry cohort, one row per customer key."""
    o = table(spark, d, "orders")
    dx = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"))
    ev = F.when((F.col("o_orderpriority") == "1-URGENT")
                & (F.col("o_orderdate") >= F.lit("1996-03-03 00:00:00").cast("timestamp_ntz")),
                F.col("o_orderdate").cast("date"))
    k = F.col("o_custkey")
    return (o.groupBy("o_custkey")
             .agg(F.min(dx).alias("dx_date"), F.min(ev).alias("event_date"))
             .select(k.alias("subject_id"), "dx_date", "event_date",
                     F.when(k % 10 == 0, F.date_add(_date("1996-01-01"), (k % 500).cast("int")))
                      .alias("death_date")))


# --- SQL texts (valid in Spark SQL and DuckDB) ------------------------------

SQL = {
    **{name: "SELECT " + ",\n  ".join(exprs) + f"\nFROM {src}" for name, (src, exprs) in EXPRS.items()},
    "fx_surv_dates": """
SELECT c_custkey AS subject_id, c_mktsegment AS grp,
  CASE WHEN c_acctbal > 4500 THEN 'Si' ELSE 'No' END AS exposed,
  MIN(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'
           THEN CAST(o_orderdate AS DATE) END) AS event_date
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey, c_mktsegment, c_acctbal""",
    "fx_surv_big_dates": """
SELECT o_orderkey AS subject_id, o_orderpriority AS grp,
  MIN(CASE WHEN l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'
           THEN CAST(l_shipdate AS DATE) END) AS event_date
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey, o_orderpriority""",
    "fx_entry": """
SELECT o_custkey AS subject_id,
  MIN(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS dx_date,
  MIN(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-03-03 00:00:00'
           THEN CAST(o_orderdate AS DATE) END) AS event_date,
  CASE WHEN o_custkey % 10 = 0 THEN DATE '1996-01-01' + CAST(o_custkey % 500 AS INT) END AS death_date
FROM orders GROUP BY o_custkey""",
}

BUILDERS = {
    "fx_rec": fx_rec, "fx_sess": fx_sess, "fx_tests": fx_tests, "fx_flags": fx_flags,
    "fx_raw": fx_raw, "fx_treat": fx_treat, "fx_dirty": fx_dirty, "fx_surv_dates": fx_surv_dates,
    "fx_surv_big_dates": fx_surv_big_dates, "fx_entry": fx_entry,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixtures as CTEs."""
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
