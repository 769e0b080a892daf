"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kohort.plans.fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle text; ``fixtures`` are prepended as CTEs.  Omit
    ``sql`` for operators with no SQL equivalent (tested by brute force).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *fixtures) if fixtures else sql.strip()
        return fn
    return deco


def gauss_jordan_sql(name: str, n: int) -> str:
    """Oracle CTEs ``name_1 .. name_n`` that turn the matrix rows ``name_0
    (i, j, v)`` into the identity, column by column; further columns of the
    table (j = 0, or above n) become the solutions."""
    steps = []
    for q in range(1, n + 1):
        m = f"{name}_{q - 1}"
        steps.append(f"""{name}_{q} AS MATERIALIZED (
  SELECT a.i, a.j, CASE WHEN a.i = {q} THEN a.v / pp.v ELSE a.v - ip.v * pj.v / pp.v END AS v
  FROM {m} a JOIN {m} ip ON ip.i = a.i AND ip.j = {q} JOIN {m} pj ON pj.i = {q} AND pj.j = a.j
  JOIN {m} pp ON pp.i = {q} AND pp.j = {q})""")
    return ",\n".join(steps)
