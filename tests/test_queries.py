"""Every registered query with SQL gives DuckDB's rows on the smallest data."""

import glob
import os

import duckdb
import pytest

from layerlens import queries

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = {c[0]: (i, str(c[1])) for i, c in enumerate(cursor.description)}
    assert sorted(df.columns) == sorted(columns)
    order = sorted(df.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: t for c, (_, t) in columns.items()}
    want = sorted(str([r[columns[c][0]] for c in order]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9684
    assert set(entry.oracle_sql()) <= set(entry.queries())
