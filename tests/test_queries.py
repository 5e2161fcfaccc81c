"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

from tests import oracle
from tracemill.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    if name in catalogue.ORACLE_SQL:
        assert oracle.compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) is None
    else:
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
