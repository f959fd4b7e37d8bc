"""Every registered query with SQL gives the rows of DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import queries as Q
from tessera.plans import careers, ranked, rules, stored  # noqa: F401  they register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(values, names):
    order = sorted(names)
    cell = lambda v: (v is None, str(round(v, 6) if isinstance(v, float) else v))
    return sorted(tuple(cell(r[names.index(n)]) for n in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in Q.SQL:
        assert got
        return
    c = con.execute(Q.SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(c.fetchall(), names)
