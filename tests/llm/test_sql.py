import pytest

from tests.oracle import same
from tidemark.llm.registry import QUERIES


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, name):
    assert same(spark, sf, *QUERIES[name])
