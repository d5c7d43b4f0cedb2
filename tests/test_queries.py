import pytest

from tests.oracle import same
from tidemark.plans.registry import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf, name):
    n = same(spark, sf, *QUERIES[name])
    assert n or name in ("asof_empty_range", "asof_before_first")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
