"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from qaflow import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.execute(SQL[name])
    theirs = [c[0] for c in rel.description]
    assert sorted(theirs) == columns
    expected = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    assert found == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
