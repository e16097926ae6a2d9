"""One local session for all tests, with small shuffles."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    built = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    connection = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return connection


def rows_of(frame) -> list[tuple]:
    """Rows as text in order, columns by name: what two engines must agree on."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))
