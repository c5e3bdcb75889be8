"""Every registered query that has SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from chronoline import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shape(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(shape(r[i]) for i in at) for r in cur.fetchall())
