"""Every registered query with SQL must give the SQL's rows; the others must run."""

import os

import duckdb
import numpy as np
import pytest

import arborlex.queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_matches_sql(spark, duck, sf, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    if name in q.ORACLE_SQL:
        want = duck.sql(q.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
