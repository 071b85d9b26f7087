"""Every registered query with SQL gives DuckDB's rows, names and types at the small scale."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quern.session import TABLES

DATA = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    theirs = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    types = {c: TYPES.get(t, t.upper().replace(" ", "")) for c, t in df.dtypes}
    assert types == {c: str(t).replace(", ", ",") for c, t in zip(theirs.columns, theirs.types)}
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
