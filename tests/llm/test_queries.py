"""Every corpus query over a whole small table."""

import time

import pytest

from kohort.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_over_the_whole_table(spark, name):
    t = time.time()
    out = QUERIES[name](spark, SMALL)
    rows = out.count()
    print(name, rows, out.columns, round(time.time() - t, 1))
    assert rows > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_the_oracle(spark, con, sf_dir, name):
    problems = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert not problems, problems
