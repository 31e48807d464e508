"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    expected = duck.sql(contract.oracle_sql()[name])
    places = [expected.columns.index(c) for c in columns]
    assert columns == sorted(expected.columns)
    assert [TYPES[dict(got.dtypes)[c]] for c in columns] == [str(expected.types[p]) for p in places]
    assert rows == sorted(str(tuple(plain(r[p]) for p in places)) for r in expected.fetchall())
