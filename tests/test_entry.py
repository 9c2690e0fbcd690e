"""Each catalogue query against its SQL at the smallest scale, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_matches_sql(spark, name):
    got = catalogue.queries()[name](spark, SF)
    data = got.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert data
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, data) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
