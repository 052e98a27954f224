"""Every query of the library against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same

from patchwell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
