"""The engine's queries by name, and their SQL for the oracle.

Queries run operators of the library over the views of `tessera.sources.corpus`. The SQL is written apart, for an engine
that shares no code with it; where SQL can't express an operator there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graphs, modules, searching, sources, states, stored


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**searching.QUERIES, **graphs.QUERIES, **states.QUERIES, **sources.QUERIES, **modules.QUERIES, **stored.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**searching.SQL, **graphs.SQL, **states.SQL, **sources.SQL, **modules.SQL, **stored.SQL}
