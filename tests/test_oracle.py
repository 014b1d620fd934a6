"""Every query against its SQL on DuckDB, over the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from estatelake import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())
    assert got == want


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        plans.queries()[name](spark, str(DATA)).count()
