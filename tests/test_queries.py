"""Every query with SQL gives the same rows in Spark and in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tilewright.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(registry.ORACLE_SQL[name])
    named = [d[0] for d in cur.description]
    assert sorted(named) == cols
    want = sorted(repr([plain(r[named.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want
