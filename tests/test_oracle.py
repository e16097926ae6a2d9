"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tessera.plans import catalog
from tests.conftest import rows_of

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, folder, duck):
    got = catalog.queries()[name](spark, folder).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
