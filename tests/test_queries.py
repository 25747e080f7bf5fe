"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from fixtures.oracle import oracle_sql
from fixtures.queries import queries

FOLDER = "/root/testdata/sf0.001"

if not Path(FOLDER).exists():
    pytest.skip("the given tables are not here", allow_module_level=True)


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in found), key=repr
    )


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, connection, name):
    df = queries()[name](spark, FOLDER)
    cursor = connection.execute(oracle_sql()[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(df.columns, [tuple(row) for row in df.collect()]) == expected
