"""The queries of this subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tessera.llm import registry
from tests.conftest import rows_of

SQL = registry.oracle_sql()


def settled(frame):
    """Whole numbers as such on both sides, also in columns with nulls."""
    frame = frame.convert_dtypes()
    return frame.astype(object).where(frame.notna(), None)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, folder, duck):
    got = registry.queries()[name](spark, folder).toPandas()
    assert rows_of(settled(got)) == rows_of(settled(duck.sql(SQL[name]).df()))


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
