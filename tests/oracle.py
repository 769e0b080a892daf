"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from kohort.sources.io import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple("\0" if x is None else x for x in t))


DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare(spark_df, con, sql):
    sc = spark_df.columns
    stypes = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(sql)
    dc = [d[0] for d in res.description]
    drows = res.fetchall()
    scols, s = rows_of(sc, srows)
    dcols, d = rows_of(dc, drows)
    problems = []
    for c, t in stypes.items():
        if c in dtypes and DUCK_TYPE.get(t, t) != dtypes[c]:
            problems.append(f"type of {c}: spark {t} duck {dtypes[c]}")
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duck={dcols}")
    if len(s) != len(d):
        problems.append(f"row count spark={len(s)} duck={len(d)}")
    if not problems and s != d:
        diff = [(a, b) for a, b in zip(s, d) if a != b][:5]
        problems.append(f"values differ, first: {diff}")
    return problems
