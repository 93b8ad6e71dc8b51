import math
import os

import duckdb
import pytest

import __spark_entry__
from rowtrail.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.SQL[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [rel.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (u[0] == v[0] == 1 and abs(u[1] - v[1]) <= 2e-5), (x, y)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["problem", "threshold", "missing_left", "gain"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
