import os

import duckdb
import pytest

from qaflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in rel.description]
    assert sorted(theirs) == columns
    expected = sorted((tuple(r[theirs.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == expected
