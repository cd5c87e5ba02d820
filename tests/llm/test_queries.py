import pytest

from notarium.llm import registry
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
