"""Every registered query against its SQL, names, types and values."""

from __future__ import annotations

import os

import compare
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as driver
from stratavec.plans import queries as library

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def plain(schema: pa.Schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in schema}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    table, expected = frame.toArrow(), con.execute(ORACLES[name]).to_arrow_table()
    assert plain(table.schema) == plain(expected.schema)
    rows = lambda t: compare._rows(t.column_names, list(zip(*[c.to_pylist() for c in t.columns])))
    assert compare.difference(rows(table), rows(expected)) is None


def test_entry(spark):
    frame = driver.entry(spark)
    assert isinstance(frame, DataFrame)
    assert frame.columns == ["layer", "kind", "bucket", "n_rows"]
    assert frame.count() > 0


def test_all_queries_have_sql():
    assert set(library.QUERIES) <= set(ORACLES)
