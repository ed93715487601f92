"""Every query with SQL, against DuckDB; the others run."""

import pytest
from helpers import assert_same

from codelode.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    if name in SQL:
        assert_same(QUERIES[name](spark, tiny), SQL[name], tiny)
    else:
        assert QUERIES[name](spark, tiny).count() > 0
