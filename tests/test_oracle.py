"""Every registered query with an oracle: Spark result == DuckDB result."""

import pytest

from kohort.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    problems = compare(df, con, ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= 0
