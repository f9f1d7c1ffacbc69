"""Every query against its SQL, on the smallest tables."""

import pytest
from pixelloom import catalogue
from support import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
