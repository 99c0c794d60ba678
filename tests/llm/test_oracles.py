"""The queries that SQL can express, against DuckDB."""

import pytest

from loomgraph.llm import registry
from tests.compare import SF, assert_same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    assert_same(registry.queries()[name](spark, SF), SQL[name])
