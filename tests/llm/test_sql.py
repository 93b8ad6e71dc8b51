"""The registered SQL gives the rows of the queries, on the small tables."""

import duckdb
import pytest

from rowtrail.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    q = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    want = sorted(map(str, q.fetchall()))
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
