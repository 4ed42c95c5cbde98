"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def catalogue():
    import __spark_entry__

    return {n: x for m in __spark_entry__.CATALOGUES for n, x in m.QUERIES.items()}


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, duck, name):
    fn, sql = catalogue()[name]
    df = fn(spark, D)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    assert plain(got) == plain(want)
