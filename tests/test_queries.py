"""Every registered query of the engine's own operators against its SQL, at the smallest scale."""

import duckdb
import pytest

from riskloom import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in catalog.oracle_sql():
        r = duck.sql(catalog.oracle_sql()[name])
        assert sorted(r.columns) == sorted(df.columns)
        names = sorted(df.columns)
        at = [r.columns.index(n) for n in names]
        assert sorted(repr(tuple(x[n] for n in names)) for x in rows) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
