"""The driver's contract: every registered query against its SQL in DuckDB."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.conftest import SCALES, TESTDATA, rows_by_name

# Spark type to the DuckDB type that the checker sees for the same values.
SAME_TYPE = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER"}
# Queries whose SQL is quick on every scale; the SQL of the others is for the middle one.
QUICK = {"pricing_summary", "op1_exact_dedup", "op7_url_filters"}
CASES = [(n, s) for n in sorted(contract.oracle_sql()) for s in SCALES if n in QUICK or s == "sf0.01"]


def test_entry_gives_the_six_groups(spark):
    assert contract.entry(spark).count() == 6


def test_sql_belongs_to_queries():
    assert {"pricing_summary"} <= contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize(("name", "scale"), CASES)
def test_query_matches_duckdb(spark, duck, name, scale):
    folder = f"{TESTDATA}/{scale}"
    views = {path.stem: str(path) for path in Path(folder).glob("*.parquet")}
    result = contract.queries()[name](spark, folder)
    expected = duck(contract.oracle_sql()[name], **views)

    types = {field.name: field.dataType.simpleString() for field in result.schema}
    assert {column: SAME_TYPE[kind] for column, kind in types.items()} == dict(
        zip(expected.columns, map(str, expected.types), strict=True)
    )
    got = rows_by_name(result.columns, result.collect())
    assert got
    assert got == rows_by_name(expected.columns, expected.fetchall())


def test_bench_prints_one_json_line():
    root = Path(contract.__file__).parent
    done = subprocess.run(
        [sys.executable, "bench.py"],
        cwd=root,
        env={**os.environ, "BENCH_SF_DIR": f"{TESTDATA}/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1", "BENCH_WARM_UPS": "0"},
        capture_output=True,
        text=True,
        timeout=1500,
        check=True,
    )
    (line,) = done.stdout.splitlines()
    report = json.loads(line)
    assert report["queries"].keys() == contract.queries().keys()
    assert report["sf"] == "0.001"
    assert report["unit"] == "sec"
    assert report["value"] > 0
