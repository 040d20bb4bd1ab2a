"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "scripts")]

import __spark_entry__ as entry  # noqa: E402
from check_queries import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    """Queries on training data may have none; their tests compare them with brute force."""
    assert set(entry.registry.QUERIES) == set(entry.registry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    got = frame.collect()
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(got, frame.columns) == rows_of(result.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["tenant_id", "path", "decision", "n", "top_score"]
