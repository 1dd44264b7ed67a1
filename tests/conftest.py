from __future__ import annotations

import duckdb
import pytest

from tarn.session import local_session

TESTDATA = "/root/testdata"
SCALES = ("sf0.001", "sf0.01", "sf0.1")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tarn-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def duck():
    """Run SQL in DuckDB over parquet files given as view name to path."""
    connections = []

    def run(sql: str, **views: str):
        connection = duckdb.connect()
        connections.append(connection)
        for name, path in views.items():
            connection.execute(f"CREATE VIEW {name} AS FROM read_parquet('{path}')")
        return connection.sql(sql)

    yield run
    for connection in connections:
        connection.close()


def rows_by_name(columns, rows) -> list[tuple]:
    """Rows with their columns in name order, themselves in a fixed order."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)
