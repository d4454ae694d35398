"""Every query of the spatial engine against its SQL, on the smallest tables."""

import os

import pytest

from geoloom import queries as q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, duck, name):
    got = q.QUERIES[name](spark, DIR)
    cur = duck.execute(q.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda it: sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in it), key=str)
    assert rows(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == rows(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, DIR).count() > 0
