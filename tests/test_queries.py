"""Every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from quarry.plans import queries as base

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shown(v):
    return None if v is None else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_same_as_sql(spark, duck, name):
    df = base.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(base.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
