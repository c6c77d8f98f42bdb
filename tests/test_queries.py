"""Every registered query with SQL against that SQL."""

from __future__ import annotations

import pytest

from souk import registry
from tests.compare import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
