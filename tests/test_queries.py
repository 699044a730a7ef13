"""Every query of the library against its SQL at the smallest size."""

import pytest
from oracle import SMALL, expected, rows

from ledgerlark.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = expected(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
