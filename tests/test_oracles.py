"""Every registered query of the engine against its SQL."""

import pytest

from loomgraph.plans import registry
from tests.compare import SF, assert_same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])
