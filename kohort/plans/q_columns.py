"""Registered queries: sources/sinks (A) and column handling (B)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from kohort.operators import columns as C
from kohort.plans import fixtures as fx
from kohort.plans.registry import register
from kohort.session import checkpoint_dir
from kohort.sources import io

V1_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in io.NA_TOKENS_V1)
V2_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in io.NA_TOKENS_V2)


@register("na_tokens", fixtures=("fx_dirty",), sql=f"""
SELECT event_id,
  CASE WHEN trim(raw_num) IN ({V1_SQL}) THEN NULL ELSE raw_num END AS num_v1,
  CASE WHEN trim(raw_num) IN ({V2_SQL}) THEN NULL ELSE raw_num END AS num_v2,
  CASE WHEN trim(raw_date) IN ({V1_SQL}) THEN NULL ELSE raw_date END AS date_v1
FROM fx_dirty""")
def q_na_tokens(spark, d):
    df = fx.fx_dirty(spark, d).select(
        "event_id", F.col("raw_num").alias("num_v1"), F.col("raw_num").alias("num_v2"),
        F.col("raw_date").alias("date_v1"))
    df = io.nullify_tokens(df, io.NA_TOKENS_V1, ["num_v1", "date_v1"])
    return io.nullify_tokens(df, io.NA_TOKENS_V2, ["num_v2"])


@register("scan_parts", sql="""
SELECT 'orders' AS part, CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', CAST(COUNT(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'customer', CAST(COUNT(*) AS BIGINT) FROM customer""")
def q_scan_parts(spark, d):
    parts = []
    for p in ("orders", "lineitem", "customer"):
        parts.append(io.read_dataset(spark, d, p, suffix=".parquet").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
                     .select(F.lit(p).alias("part"), "n_rows"))
    return io.union_all(parts)


@register("roundtrip_clean", fixtures=("fx_rec",), sql="SELECT * FROM fx_rec")
def q_roundtrip_clean(spark, d):
    path = os.path.join(checkpoint_dir(spark), f"clean-{uuid.uuid4().hex}")
    io.write_clean(fx.fx_rec(spark, d), path)
    return io.read_clean(spark, path)


_ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                 ("o_orderpriority", "string")]


@register("data_dictionary", sql="\nUNION ALL\n".join(
    f"SELECT CAST({i + 1} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS data_type, "
    f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_missing, "
    f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_distinct, '' AS description FROM orders"
    for i, (c, t) in enumerate(_ORDERS_TYPES)))
def q_data_dictionary(spark, d):
    return io.data_dictionary(io.table(spark, d, "orders"), exact=True)


@register("clean_names", sql="""
SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS estado_nandu,
       o_totalprice AS total_percent, o_orderdate AS x2nd_date, o_orderpriority AS order_key_2
FROM orders""")
def q_clean_names(spark, d):
    o = io.table(spark, d, "orders")
    ugly = o.select(F.col("o_orderkey").alias("Order Key"), F.col("o_custkey").alias("custKey"),
                    F.col("o_orderstatus").alias("Estado Ñandú"), F.col("o_totalprice").alias("Total %"),
                    F.col("o_orderdate").alias("2nd date"), F.col("o_orderpriority").alias("order key"))
    return C.clean_names(ugly)


@register("rename_cols", sql="""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
       o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def q_rename_cols(spark, d):
    return C.rename(io.table(spark, d, "orders"),
                    {"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus"})


@register("select_rename", sql="""
SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity, l_shipdate AS ship_date FROM lineitem""")
def q_select_rename(spark, d):
    return C.select_rename(io.table(spark, d, "lineitem"),
                           [("order_id", "l_orderkey"), ("line", "l_linenumber"), "l_quantity",
                            ("ship_date", "l_shipdate")])


@register("drop_cols", fixtures=("fx_flags",), sql="""
SELECT record_id, subject_id, co_f1, co_f5, co_f6 FROM fx_flags""")
def q_drop_cols(spark, d):
    return C.drop_cols(fx.fx_flags(spark, d), "grp", C.between("co_f2", "co_f4"))


@register("select_prefix", fixtures=("fx_flags",), sql="""
SELECT co_f1, co_f2, co_f3, co_f4, co_f5, co_f6 FROM fx_flags""")
def q_select_prefix(spark, d):
    return C.select_cols(fx.fx_flags(spark, d), C.starts_with("CO_"))


@register("select_suffix", sql="SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def q_select_suffix(spark, d):
    return C.select_cols(io.table(spark, d, "lineitem"), C.ends_with("key"))


@register("select_contains", sql="""
SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders""")
def q_select_contains(spark, d):
    return C.select_cols(io.table(spark, d, "orders"), C.contains("order"))


@register("select_matches", sql="SELECT o_totalprice, o_orderdate FROM orders")
def q_select_matches(spark, d):
    return C.select_cols(io.table(spark, d, "orders"), C.matches(r"^o_.*(date|price)$"))


@register("select_where_type", sql="""
SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def q_select_where_type(spark, d):
    return C.select_cols(io.table(spark, d, "lineitem"), C.where_type("double"))


@register("select_range", sql="SELECT l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def q_select_range(spark, d):
    return C.select_cols(io.table(spark, d, "lineitem"), C.between("l_partkey", "l_quantity"))


@register("select_combine", fixtures=("fx_flags",), sql="""
SELECT record_id, co_f1, co_f2, co_f5, co_f6 FROM fx_flags""")
def q_select_combine(spark, d):
    sel = (C.names("record_id") | C.starts_with("co_")) & ~C.between("co_f3", "co_f4")
    return C.select_cols(fx.fx_flags(spark, d), sel)


@register("mutate_across", sql="""
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, l_extendedprice * 2 AS l_extendedprice,
       l_discount * 2 AS l_discount, l_tax * 2 AS l_tax FROM lineitem""")
def q_mutate_across(spark, d):
    li = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                               "l_extendedprice", "l_discount", "l_tax")
    return C.mutate_across(li, C.where_type("double"), lambda c: c * 2)


@register("deidentify_project", sql="""
SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer""")
def q_deidentify_project(spark, d):
    cu = io.table(spark, d, "customer")
    return C.final_projection(cu, ["c_custkey", C.starts_with("c_nation"), C.contains("segment"),
                                   C.ends_with("acctbal")], identifiers=["c_name"])


@register("read_csv_tokens", fixtures=("fx_dirty",), sql=f"""
SELECT CASE WHEN CAST(event_id AS VARCHAR) IN ({V2_SQL}) THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
  CASE WHEN trim(raw_num) IN ({V2_SQL}) THEN NULL ELSE raw_num END AS raw_num,
  CASE WHEN trim(raw_date) IN ({V2_SQL}) THEN NULL ELSE raw_date END AS raw_date
FROM fx_dirty""")
def q_read_csv_tokens(spark, d):
    path = os.path.join(checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    fx.fx_dirty(spark, d).write.option("header", "true").csv(path)
    return io.read_table(spark, path, na_tokens=io.NA_TOKENS_V2)
