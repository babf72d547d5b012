import pytest

from lotlake.queries import QUERIES, SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 6
