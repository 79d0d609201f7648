"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from lostfound.plans import registered as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, duck, name):
    got = R.QUERIES[name](spark, SF)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    if name in R.ORACLE:
        cur = duck.execute(R.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(got.columns)
        theirs = rows(names, cur.fetchall())
        assert len(mine) == len(theirs)
        assert mine == theirs
