"""Queries that SQL can express, against that SQL."""

import pytest

from tests import oracle
from tracemill.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert oracle.compare(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.ORACLE_SQL[name]) is None
