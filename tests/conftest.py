import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session("tests", 4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    """A value that compares alike, whichever engine it is from."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(df, *columns):
    columns = columns or sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, DATA)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        expected = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
        assert rows_of(df) == expected

    return check
