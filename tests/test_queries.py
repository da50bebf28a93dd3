"""Every query with SQL returns the rows of its SQL."""

import pytest

from cadenza import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
