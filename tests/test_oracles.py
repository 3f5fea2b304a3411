"""Every query of the library against its DuckDB twin."""

import pytest
from compare import SF, same

from larder import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["name"] for r in sorted(rows)] == ["node-a", "node-b", "node-c"]
    assert set(plans.queries()) <= set(entry.queries()) and set(plans.oracles()) <= set(entry.oracle_sql())
