"""Every registered query of the dialect against DuckDB."""

import duckdb
import pytest

from plainsql import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in Q.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(plain(r[df.columns.index(c)]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert ours == theirs
