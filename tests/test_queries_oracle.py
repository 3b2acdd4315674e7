"""Every registered query with an SQL oracle must match DuckDB at the test scale."""

import pytest

from tests.conftest import SF
from tests.oracle import assert_same


def _names():
    from flowrisk.plans.catalog import ORACLE_SQL, load_all
    load_all()
    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from flowrisk.plans.catalog import ORACLE_SQL, QUERIES
    assert_same(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
